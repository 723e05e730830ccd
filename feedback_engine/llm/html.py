"""Main-text extraction from web pages by two-pass block rules.

Pass 1 looks at a block's stop-word density, length and link density and calls it
main text, boilerplate, or leaves it open. Pass 2 gives an open block the label of
its nearest decided neighbours in the same container (an article, a marked part,
or what is around them); where they differ, main text wins in an article, else the
nearer one, and a heading goes with what follows. Where a whole container is open,
it decides itself: an article is kept, a page without one too.

Structure is evidence beside that. What the elements nav, header, footer, aside,
form and the like hold is out. Of the words in class, id and role, strong ones
(comments, sidebar, advert) are out unless a page has no main text elsewhere; weak
ones (widget, social) only ask for more: their blocks stay if they are dense and
long by themselves. A mark beside a word of another kind ("share-price"), or one
that may be an article's subject ("related"), leaves its part in doubt: it is read
like any other if it holds dense prose of some length, and is out if not. A short
block that tells of cookies and asks for consent is a notice, marked or not. On a page with hardly a known stop word density says nothing:
length and links decide.

Pages are independent rows, so this is one scan without a shuffle. Tags are read
by a scanner that is linear in the page's length whatever is unclosed in it.

Defined cases: null or empty html gives empty text; unclosed and badly nested
elements are closed by the block that follows; an unclosed comment, script or tag
hides the rest, as in browsers; an unclosed quote ends with its tag; character
references are decoded once, an unfinished one stays as it is; a repeated row
gives a repeated result; an empty table gives an empty one. Other columns stay as
they are, but columns of the input named text or n_chars are replaced.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.common import small_batches, table

#: Elements whose content is no text at all.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "textarea", "select", "button", "canvas", "audio", "video")
#: Those of them that only their end tag ends, so an unclosed one reaches to the end of the page.
RAW_TEXT = {"script", "style", "iframe", "title", "textarea"}
#: Elements around boilerplate.
FRAME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Elements that start and end a block.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that other end tags don't reach beyond.
BOUNDS = ("article", "main", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in class, id and role of what is no main text whatever it holds; those of a page's head are so only outside of an article.
STRONG = re.compile(r"ad|ads|advert\w*|adsense|sponsor\w*|breadcrumbs?|comments?|commentlist|disqus|replies|reply|respond|consent|cookies?|gdpr|notices?|notification|footer|contentinfo|menu|nav|navbar|navigation|pagination|sidebar|complementary")
HEAD_MARKS = re.compile(r"header|masthead|topbar")
#: Words that mean the same around few words, but may be the subject of an article's part.
SOFT = re.compile(r"banner|newsletter|popup|promo\w*|related|share|sharing|subscribe")
WEAK = re.compile(r"disclaimer|modal|social|toolbar|widget")
#: Words beside a mark that say where it is or how it is made, not what it is about.
FORM = re.compile(r"\d*|area|bar|block|body|bottom|box|btn|buttons?|center|container|content|form|group|heading|holder|icons?|inner|inline|items?|label|left|links?|lists?|main|mobile|outer|overlay|panel|posts?|right|section|site|slot|small|sticky|text|threads?|title|top|unit|wrap|wrapper|primary|secondary|message")
#: A short block that tells of a site's cookies and asks for consent is a notice, marked or not.
COOKIES = re.compile(r"\b(?:site|website|page|we|wir|nous|utili[sz]\w*|verwend\w*)\b.{0,40}\bcookies?\b", re.I)
CONSENT = re.compile(r"\b(?:accept\w*|agree|allow|consent|decline|reject|akzeptier\w*|zustimm\w*|refuser|acepta\w*|rechazar)\b", re.I)
#: A layout that says what it has, not what it is.
LAYOUT = re.compile(r"^(?:no|has|with|without|is|page|layout)[_-]|[_-]free$", re.I)
#: Frequent function words of the languages in hand; density is a share of words.
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with be at by this have from or he she they we you not an which but had his her their has were been will would there a i if can all do "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so "
    "le la les de des et est un une du que qui dans en pour par sur au aux avec il elle ne pas plus ce se son sa ses ou mais comme nous vous ils sont été cette "
    "el los las y en del que se por con una para su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde no es".split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
WORD = re.compile(r"\w+")
OPEN, HARD, MARKED, FAINT, DOUBT = range(5)  # what is around a block: nothing, an element of FRAME, a strong mark, a weak one, one that may be a subject


class Block(NamedTuple):
    text: str
    linked: int  # characters of it in links
    around: int
    article: bool
    container: int
    tag: str


class Scanner:
    """Tags of a page; every search that fails is remembered, so none is made twice."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_of(self, name: str, at: int, nested: bool) -> int:
        """The place after the next end tag of an element, -1 if there is none; with nested, none beyond another start tag of it."""
        if name in self.missing:
            return -1
        m = re.compile(rf"</{name}\s*>" if not nested else rf"<(?:/{name}\s*>|{name}(?=[\s/>]))", re.I).search(self.page, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.end() if m[0][1] == "/" else -1

    def tag(self, at: int) -> tuple[int, dict[str, str], bool]:
        """From the end of a tag's name: the place after the tag (-1 if it never ends), its attributes, whether it closes itself."""
        page, found, slash = self.page, {}, False
        while True:
            m = ATTRIBUTE.match(page, at)
            if m is None:
                while at < len(page) and page[at] != ">":  # blanks, slashes and stray signs
                    slash = page[at] == "/" or slash and page[at].isspace()
                    at += 1
                return (at + 1 if at < len(page) else -1), found, slash
            name, at, value, slash = m[1].lower(), m.end(), "", False
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = UNQUOTED.match(page, at)
                    value, at = u[0], u.end()
                    slash = value.endswith("/")
            if name not in found:
                found[name] = value


def surroundings(name: str, attributes: dict[str, str], inside: bool) -> int:
    """What an element says about what it holds, by its name, class, id, role and style."""
    if name in ("html", "body", "main"):
        return OPEN
    if name in FRAME and not (name == "header" and inside) or "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return HARD
    said = {meaning(t, inside, name == "article") for t in " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split()}
    return next((x for x in (MARKED, FAINT, DOUBT) if x in said), OPEN)


def meaning(token: str, inside: bool, article: bool = False) -> int:
    """What a word of class, id or role says, in an article or outside.

    A mark decides if the rest of its token is form ("ad-slot", "comment-list"); in
    other company ("share-price", "related-work") it is in doubt, and so is a soft
    mark in an article.
    """
    parts = re.split("[-_]+", token.lower())
    if LAYOUT.search(token):
        return OPEN
    strong = [p for p in parts if STRONG.fullmatch(p) or not inside and not article and HEAD_MARKS.fullmatch(p)]
    soft, weak = [p for p in parts if SOFT.fullmatch(p)], [p for p in parts if WEAK.fullmatch(p)]
    if not (strong or soft or weak):
        return OPEN
    subject = any(not (p in strong or p in soft or p in weak or FORM.fullmatch(p)) for p in parts)
    if strong or soft:
        return DOUBT if subject or not strong and inside else MARKED
    return FAINT


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out, parts, linked = [], [], 0
    stack: list[tuple[str, int, int]] = []  # open elements, what they say, and the container around them
    opened, inside = Counter(), [Counter()]  # how many of each name are open, at all and since the last of BOUNDS
    around, containers, container = Counter(), 0, 0
    articles = links = 0
    tag, at, n = "", 0, len(page)
    scanner, hidden = Scanner(page), ""  # hidden: unclosed element of RAW whose content goes on to the next block

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at and not hidden:
            parts.append(page[at:upto])
            linked += (upto - at) * (links > 0)

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            joined = " ".join(references.unescape("".join(parts)).split())
            if joined:
                out.append(Block(joined, linked, next((x for x in (HARD, MARKED, FAINT, DOUBT) if around[x]), OPEN), articles > 0, container, tag))
        parts, linked = [], 0

    def close(to: int) -> None:
        nonlocal articles, links, container
        while len(stack) > to:
            name, said, container = stack.pop()
            around[said] -= 1
            articles -= name in ("article", "main")
            links -= name == "a"
            if name in BOUNDS:
                inside.pop()
            inside[-1][name] -= 1
            opened[name] -= 1

    while at < n:
        start = scanner.find("<", at)
        if start < 0:
            text(n)
            break
        name = NAME.match(page, start + 2 if page[start + 1 : start + 2] == "/" else start + 1)
        if name is None:
            if page.startswith("<!--", start):
                text(start)
                end = scanner.find("-->", start + 2)
                at = end + 3 if end >= 0 else n
            elif page[start + 1 : start + 2] in ("!", "?"):
                text(start)
                end = scanner.find(">", start)
                at = end + 1 if end >= 0 else n
            else:  # a sign, not a tag
                text(start + 1)
                at = start + 1
            continue
        closing = page[start + 1] == "/"
        end, attributes, slash = scanner.tag(name.end())
        name = name[0].lower()
        text(start)
        if end < 0:
            break
        at = end
        if name in BLOCKS:
            end_block()
            tag = "" if closing else name
            hidden = ""
        if closing:
            hidden = "" if name == hidden else hidden
            if (opened if name in ("html", *BOUNDS) else inside[-1])[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW and not slash:
            end = scanner.end_of(name, at, name not in RAW_TEXT and name not in ("head", "template"))
            if end >= 0:
                at = end
                continue
            if name in RAW_TEXT:
                at = n
                continue
            if name != "head":
                hidden = hidden or name
                continue
        if name in VOID or slash:
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        said = surroundings(name, attributes, articles > 0)
        stack.append((name, said, container))
        inside[-1][name] += 1
        opened[name] += 1
        if name in BOUNDS:
            inside.append(Counter())
        if said or name in ("article", "main"):
            containers += 1
            container = containers
        around[said] += 1
        articles += name in ("article", "main")
        links += name == "a"
    end_block()
    return out


def classify(found: list[Block], short: int = 70, long: int = 200, low: float = 0.12, high: float = 0.22, links: float = 0.33) -> list[bool]:
    """For each block, whether it is main text."""
    stops = []  # stop words and words of each block
    for b in found:
        words = WORD.findall(b.text.lower())
        stops.append((sum(w in STOP_WORDS for w in words), len(words)))
    seen = [x for x, b in zip(stops, found, strict=True) if b.around != HARD]
    # Below what a block of prose has, on the whole page: its language is not one of those in hand.
    foreign = sum(x[0] for x in seen) < low * sum(x[1] for x in seen)
    # A part in doubt is like any other if it holds prose of some length, else out.
    prose = lambda b, x: len(b.text) >= long and (foreign or x[0] >= low * x[1]) and b.linked <= links * len(b.text)
    cleared = {b.container for b, x in zip(found, stops, strict=True) if b.around == DOUBT and prose(b, x)}
    first: list[bool | None] = []
    for b, (n_stops, n_words) in zip(found, stops, strict=True):
        density, size = n_stops / max(n_words, 1), len(b.text)
        if b.around == HARD or b.around == DOUBT and b.container not in cleared:
            first.append(False)
        elif size < long and COOKIES.search(b.text) and CONSENT.search(b.text):
            first.append(False)
        elif b.linked > links * size if not b.article else b.tag == "li" and b.linked > 0.8 * size and (size < long or density < high):
            first.append(False)  # in an article, a list of links that reads like no prose
        elif size >= (long if b.around == FAINT else short) and (density >= high or foreign and size >= (short if b.article else long)) or size >= long and density >= low:
            first.append(True)
        elif b.around == FAINT or size >= short and density < low and not (foreign or b.article):
            first.append(False)
        else:
            first.append(None)
    # Strong marks hold but where the only prose of a page is in what they mark.
    if any(x and b.around != MARKED or b.article and b.around == OPEN for x, b in zip(first, found, strict=True)) or not any(x and len(b.text) >= long for x, b in zip(first, found, strict=True)):
        first = [False if b.around == MARKED else x for x, b in zip(first, found, strict=True)]
    # The nearest decided block of the same container, on either side.
    before, after = [-1] * len(found), [-1] * len(found)
    for places, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            places[i] = last.get(found[i].container, -1)
            if first[i] is not None:
                last[found[i].container] = i
    whole = not any(x for x in first) and not any(b.article for b in found)
    out = []
    for i, (x, b) in enumerate(zip(first, found, strict=True)):
        if x is None:
            a, z = before[i], after[i]
            near = [first[j] for j in (a, z) if j >= 0]
            if not near:
                x = b.article or whole
            elif b.tag in HEADINGS and z >= 0:
                x = first[z]
            elif len(set(near)) == 1 or b.article:
                x = any(near)
            else:
                x = first[a] if i - a <= z - i else first[z]
        out.append(bool(x))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, kept in zip(found, classify(found), strict=True) if kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with its html replaced by text (string, never null) and n_chars (long)."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["row", "text", "n_chars"])

    out = rows.mapInArrow(run, rows.select("row").schema.add("text", "string").add("n_chars", "long"))
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "text", "n_chars")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
