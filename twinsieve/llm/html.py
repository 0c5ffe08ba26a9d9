"""Main text of web pages by two-pass block rules.

A page is cut at block-level elements. First pass: what stands around a block (menus, sidebars, forms,
comments and the like, by element, role, or class and id words) or an article around it decide; elsewhere
link density, length and the density of stop words do, and short blocks stay undecided. Second pass:
undecided blocks take the label of the nearest decided neighbours.

Defined cases: null and empty pages, and pages without text, give an empty text; markup that ends early is
read as far as it goes; with no decided block on a page, its undecided ones are kept; repeated rows
are extracted each by itself. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, pieces, texts, tidy
from twinsieve.session import ship_package

#: Names of HTML elements and common words.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg math object canvas audio video title noframes".split())
BOILERPLATE = frozenset("nav aside footer form button dialog menu".split())
CONTENT = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset("""nav navbar navigation menu menubar header masthead footer sidebar aside banner notice cookie cookies
consent gdpr ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion comment comments
commentlist disqus reply replies respond form search share sharing social subscribe newsletter breadcrumb breadcrumbs
related recommended widget popup modal login signup toolbar pagination pager copyright""".split())
#: A class or id name is a mark if it is one, if it begins with one and goes on with marks or words of these
#: (sidebar-widgets), or ends with one after a word of the site's frame (site-footer); names such as
#: has-sidebar, nav-open, entry-header or related-work say nothing of the element itself.
MARK_TAILS = frozenset("""area wrapper wrap container inner outer bar box block list links menu menus widget widgets
section region top bottom left right primary secondary posts articles items item content main""".split())
FRAME_HEADS = frozenset("site page global main primary secondary top bottom left right mobile desktop sticky fixed".split())
STOP_WORDS = frozenset("""a an and are as at be but by for from had has have he her his i in is it its not of on or she that
the their there they this to was we were which with you
aber als auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht
oder sich sie sind so über um und von vor war werden wie wir zu zum zur
au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qu que qui sa
se ses son sont sur un une vous
al como con del el ella ellos entre era esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque se
ser si sin su sus también te un una uno y ya""".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
                   re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
LETTERS = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Rules:
    short: int = 70
    long: int = 200
    stop_low: float = 0.22
    stop_high: float = 0.3
    links: float = 0.33
    known_language: float = 0.05  # stop-word density of a page below which its language is not in the lists


@dataclass
class Block:
    parts: list[tuple[str, bool]] = field(default_factory=list)  # text, inside a link
    boilerplate: bool = False
    content: bool = False

    def text(self) -> str:
        return " ".join("".join(t for t, _ in self.parts).split())


def marked(value: str) -> bool:
    """Whether a class or id value names boilerplate, by whole names or anchored patterns."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if name in MARKS or (parts and (
                (parts[0] in MARKS and len(parts) > 1 and all(p in MARK_TAILS or p in MARKS for p in parts[1:]))
                or (parts[-1] in MARKS and len(parts) > 1 and parts[0] in FRAME_HEADS))):
            return True
    return False


def _flags(name: str, attributes: str, content: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate by its element, role or hiding; by a class or id mark; and
    whether it is the page's content."""
    hard = name in BOILERPLATE or (name == "header" and not content)
    soft = False
    good = name in CONTENT
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "role":
                hard |= value.lower() in ROLES
                good |= value.lower() in CONTENT
            elif key in ("class", "id") and name not in ("html", "body", "article", "main"):
                soft |= marked(value)
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
                hard = True
    return hard, soft, good


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    out: list[Block] = []
    block = Block()
    # name, boilerplate, content, link, boilerplate by element, role or hiding (not by a class or id mark)
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]

    def close() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(boilerplate=stack[-1][1], content=stack[-1][2])

    def text(raw: str) -> None:
        if raw and (block.parts or not raw.isspace()):
            block.parts.append((unescape(raw) if "&" in raw else raw, stack[-1][3]))

    at = 0
    end = len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at:found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCKS:
                close()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            if name in BLOCKS or stack[-1][1] != block.boilerplate:
                close()
            continue
        if name == "br":
            text(" ")
            continue
        if name in RAW:
            if not found[3].endswith("/"):
                last = re.compile(rf"</{re.escape(name)}[^>]*>", re.IGNORECASE).search(html, at)
                at = last.end() if last else end
            text(" ")
            continue
        if name in BLOCKS:
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or any(s[0] == "p" for s in stack[-8:]):
                _imply_end(stack, name)
            close()
        if name in VOID or found[3].endswith("/"):
            continue
        _, bad, good, link, hard = stack[-1]
        own_hard, own_soft, own_good = _flags(name, found[3], good)
        own_bad = own_hard or own_soft
        if own_good and not own_bad:  # an article or main element resets marks inherited from class names
            bad = hard
        stack.append((name, bad or own_bad, (good or own_good) and not own_bad, link or name == "a", hard or own_hard))
        if name in BLOCKS:
            close()
        elif own_bad and not bad:
            close()
    close()
    return [b for b in out if b.text()]


def _imply_end(stack: list[tuple[str, bool, bool, bool, bool]], name: str) -> None:
    """A new block ends an open paragraph, and a new item the item before it."""
    closes = {"p", "li"} if name == "li" else {"p", "dt", "dd"} if name in ("dt", "dd") else \
        {"p", "td", "th"} if name in ("td", "th") else {"p", "td", "th", "tr"} if name == "tr" else {"p", "option"}
    cut = None
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in closes:
            cut = depth
        elif stack[depth][0] in BLOCKS:
            break
    if cut is not None:
        del stack[cut:]


def stop_density(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def first_pass(block: Block, rules: Rules, known_language: bool = True) -> bool | None:
    """Content, boilerplate, or None for an undecided block.

    Where the page's words hold almost no stop word of the lists, its language is not one of theirs:
    long blocks with few links are content, and density says nothing.
    """
    if block.boilerplate:
        return False
    if block.content:
        return True
    whole = block.text()
    linked = sum(len(t.strip()) for t, link in block.parts if link)
    if linked > rules.links * len(whole) or ("©" in whole and len(whole) < rules.short):
        return False
    if len(whole) < rules.short:
        return None
    if not known_language:
        return True if len(whole) > rules.long else None
    density = stop_density(whole)
    if density >= rules.stop_high:
        return True if len(whole) > rules.long else None
    return None if density >= rules.stop_low else False


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks get the label of their nearest decided neighbours; content wins if both are as near."""
    decided = [i for i, x in enumerate(labels) if x is not None]
    if not decided:
        return [True] * len(labels)
    out, k = [], 0
    for i, label in enumerate(labels):
        while k < len(decided) and decided[k] < i:
            k += 1
        if label is not None:
            out.append(label)
            continue
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None or after is None:
            out.append(bool(labels[after if before is None else before]))
        elif i - before == after - i:
            out.append(bool(labels[before] or labels[after]))
        else:
            out.append(bool(labels[before if i - before < after - i else after]))
    return out


def main_text(html: str, rules: Rules | None = None) -> str:
    """The kept blocks, white space made single, joined by line ends."""
    rules = rules or Rules()
    blocks = blocks_of(html)
    known = stop_density(" ".join(b.text() for b in blocks if not b.boilerplate)) >= rules.known_language
    kept = second_pass([first_pass(b, rules, known) for b in blocks])
    return "\n".join(b.text() for b, keep in zip(blocks, kept, strict=True) if keep)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [main_text(h, rules) for h in texts(part.column(2))]
                yield emit(EXTRACTED, [part.column(0), part.column(1), found, [len(t) for t in found]])

    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
