"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines: runs of text between block-level tags or line breaks, in page order. Elements
that hold no prose by their nature (scripts, styles, controls, menus, the site's headers and footers, asides) leave no
lines. The text lengths of the others, links taken off, are summed over sliding windows of WINDOW lines. A surge
is where the sum rises to the threshold, a dive where it falls back to nothing; the stretch between them with the most
text is the main text, all of it, and so are further stretches in the same section of the page, after a
list of links, say.

Marks. A class, id or role may name a notice, an advert, a form or comments. It takes an element's lines away only
if the rest of the page weighs against it: a quarter at least as much text outside as inside (a twentieth for comments), any
where the element is small, or an article or main element beside it. So a name on a wrapper of the page drops nothing. A
header inside an article stays if it has a heading.

Ends. Lines at an end of the stretch that lie outside the section with nearly all its text go if they are mostly links,
a copyright line, or a short line in a box of their own. An article or main element around nearly all the stretch's text
gives its other lines too, so that short lines at an article's start or end stay with it.

Defined cases: null or empty html has no text, as has a page of menus and footers alone; unclosed and crossing tags are
taken as browsers take them for the purpose (an end tag closes up to its start, unknown ones are ignored); a page cut
off anywhere keeps what came before; pages too short for a surge keep all their lines; pages are rows, so repeated rows
and null keys stay; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import small_batches, tidy

#: Element names by role.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video map button select textarea input label nav footer aside menu dialog head title".split())
FORMS, HEADINGS, ARTICLES = frozenset(("form", "fieldset")), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("article", "main"))
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article main section div body".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets header masthead topbar toolbar footer foot copyright colophon legal cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular pagination pager comment comments commentlist disqus replies respond reactions reviews feedback discussion search searchbox form complementary contentinfo tags taglist".split()
)
#: Marks that rule out an article element too, of readers' comments, of headers, and first words of names that describe something else.
REMARKS = frozenset("ad ads advert advertisement comment comments promo related replies respond sponsored".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond reactions reviews discussion".split())
HEADERS = frozenset("header masthead topbar banner".split())
MODIFIERS = frozenset("has no not with without is tag category cat type format status hide show".split())
#: Lines of a window, characters that make a surge, share of a stretch's text that its section holds, text outside an element for each character inside that lets a mark drop it, and characters of a small element.
WINDOW, SURGE, NEARLY = 3, 40, 0.9
OUTSIDE, LITTLE = {"mark": 0.25, "form": 0.25, "hidden": 0.25, "comments": 0.05, "header": 0.05}, 200
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|\ball rights reserved\b", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _mark(name: str, attributes: str, inside_article: bool) -> str | None:
    """What an element may be dropped as: "always", a key of OUTSIDE, or None."""
    if name in DROPPED or name == "header" and not inside_article:
        return "always"
    if name == "header":
        return "header"
    if name in ("body", "html", "main"):
        return None
    if attributes:
        if HIDDEN.search(attributes):
            return "hidden"
        words: set[str] = set()
        for values in ATTRIBUTE.findall(attributes):
            for token in "".join(values).split():
                parts = _WORD.findall(_CAMEL.sub(" ", token).lower())
                if parts and parts[0] not in MODIFIERS:
                    words.update(parts)
        marks = MARKS & words
        if marks and (name != "article" or marks & REMARKS):
            return "comments" if marks & COMMENTS else "header" if marks <= HEADERS and inside_article else "mark"
    return "form" if name in FORMS else None


class Block:
    __slots__ = ("text", "linked", "sections", "marked", "heading")

    def __init__(self, text: str, linked: int, sections: tuple[tuple[int, str], ...], marked: tuple[int, ...], heading: bool):
        self.text, self.linked, self.sections, self.marked, self.heading = text, linked, sections, marked, heading

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.linked)


def blocks(html: str) -> list[Block]:
    """The page's lines but for those in marked elements: text with folded white space, characters in links, open sections."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, number
    marks: dict[int, str] = {}  # of elements that may go, by number
    parts: list[str] = []
    dropped = linked = anchors = number = 0
    text_start = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            parts.append(raw)
            if anchors:
                linked += len(raw.strip())

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                sections = tuple((n, name) for name, _, n in stack if name in SECTIONS)
                out.append(Block(text, linked, sections, tuple(n for _, _, n in stack if n in marks), any(name in HEADINGS for name, _, _ in stack)))
            parts.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        at = html.find("<", at)
        if at < 0:
            break
        m = TOKEN.match(html, at)
        if not m:
            at += 1
            continue
        add(html[text_start:at])
        at = text_start = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            end_block()
        if m[1]:
            if any(n == name for n, _, _ in stack):
                while True:
                    popped, bad, _ = stack.pop()
                    dropped -= bad
                    anchors -= popped == "a"
                    if popped == name:
                        break
            continue
        if name == "p" or name in BLOCKS:  # a new block closes an open paragraph
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SECTIONS), None)
            if k is not None and stack[k][0] == "p" and name != "br":
                for popped, bad, _ in stack[k:]:
                    dropped -= bad
                    anchors -= popped == "a"
                del stack[k:]
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            dropped -= stack.pop()[1]
        if name in VOID or m[3].endswith("/") and name in RAW - {"script"}:
            continue
        mark = _mark(name, m[3], any(n in ARTICLES for n, _, _ in stack))
        number += 1
        if mark and mark != "always":
            marks[number] = mark
        stack.append((name, mark == "always", number))
        dropped += mark == "always"
        anchors += name == "a"
        if name in RAW:  # no tags inside
            end = re.compile(f"</{re.escape(name)}[\\s/>]|\\Z", re.I).search(html, at)
            add(html[text_start : end.start()])
            at = text_start = end.start()
    add(html[text_start:])
    end_block()
    gone = believed(out, marks)
    return [b for b in out if gone.isdisjoint(b.marked)] if gone else out


def believed(lines: list[Block], marks: dict[int, str]) -> set[int]:
    """The marked elements whose lines go: those beside an article, and of the others those that the rest of the text outweighs."""
    in_article = [b for b in lines if any(name in ARTICLES for _, name in b.sections)]
    beside = set(marks).difference(*(b.marked for b in in_article)) if in_article else set()
    inside, headed, total = dict.fromkeys(marks, 0), set(), 0
    for b in lines:
        if beside.isdisjoint(b.marked):
            weight = b.weight
            total += weight
            for n in b.marked:
                inside[n] += weight
                if b.heading:
                    headed.add(n)
    weighed = {n for n, mark in marks.items() if total - inside[n] >= min(OUTSIDE[mark] * inside[n], 1 if inside[n] <= LITTLE else total)}
    return (weighed | beside) - {n for n in headed if marks[n] == "header"}


def stretches(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First line and line after the last of each stretch from surge to dive."""
    n, k, found = len(lengths), 0, []
    sums = [sum(lengths[k : k + window]) for k in range(n)]
    while k < n:
        if sums[k] < surge:
            k += 1
            continue
        start = k
        while k < n and sums[k] > 0:
            k += 1
        while not lengths[start]:
            start += 1  # the window before a surge may start with lines of links alone
        found.append((start, k))
    return found


def section_of(lines: list[Block], names: frozenset, share: float) -> tuple[int, str] | None:
    """The innermost section of these names that holds such a share of the lines' text."""
    held: dict[tuple[int, str], int] = {}
    for b in lines:
        for s in b.sections:
            if s[1] in names:
                held[s] = held.get(s, 0) + b.weight
    least = share * sum(b.weight for b in lines)
    return max((s for s, w in held.items() if w >= least), default=None)  # numbered as they open


def _loose(b: Block, around: tuple) -> bool:
    """Whether a line at a stretch's end is no part of it; around: the sections of the stretch's own section, outermost first."""
    if not around or around[-1] in b.sections or b.heading:
        return False
    own_box = bool(b.sections) and b.sections[-1] not in around
    return 2 * b.linked > len(b.text) or bool(COPYRIGHT.search(b.text)) or own_box and len(b.text) < SURGE


def main_text(html: str | None) -> str:
    """The main text; its lines joined by a line feed."""
    found = blocks(html or "")
    weights = [b.weight for b in found]
    parts = stretches(weights)
    if not parts:
        return "\n".join(b.text for b in found)  # too little text for a surge: all of it
    first, last = max(parts, key=lambda p: (sum(weights[slice(*p)]), -p[0]))
    article = section_of(found[first:last], ARTICLES, NEARLY)
    if article:
        return "\n".join(b.text for k, b in enumerate(found) if first <= k < last and not (article not in b.sections and _loose(b, (article,))) or article in b.sections)
    inner = section_of(found[first:last], SECTIONS, NEARLY)
    around = next((b.sections[: b.sections.index(inner) + 1] for b in found[first:last] if inner in b.sections), ())
    while last - first > 1 and _loose(found[first], around):
        first += 1
    while last - first > 1 and _loose(found[last - 1], around):
        last -= 1
    lines = list(range(first, last))
    if len(around) > 1:  # other stretches' lines in the same section, but not in one inside it
        for a, z in parts:
            own = [k for k in range(a, z) if not first <= k < last and found[k].sections == around]
            lines += own if sum(weights[k] for k in own) >= SURGE else []
    return "\n".join(found[k].text for k in sorted(lines))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return small_batches(pages).select("page_id", "url", F.col("html").cast("string")).mapInArrow(tidy(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
