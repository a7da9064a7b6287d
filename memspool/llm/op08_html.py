"""HTML extraction by two-pass block rules.

A page is cut into blocks at its block-level tags.  The first pass labels each block by link density, stop-word density and
length: bad where links or a copyright mark dominate, good where it is long enough and has the stop words of prose,
ambiguous otherwise.  In the second pass an ambiguous block takes the label of its nearest decided neighbours, where a *section*, from a heading or a bad
block to the next one, is looked at first:

* in a section with a good block the ambiguous ones are good;
* of one with none, what follows its heading is judged together, as one block; if no section of the page is good, the largest one under a heading is;
* a heading with nothing behind it goes with what follows;
* any other takes the label of the nearer decided block outside, above or below, but not beyond a heading below: what stands before a title isn't part of its text.  At equal
  distance it goes with the one above; with neither it is bad.

These rules need no markup but headings and links.  ``article``, ``main``, elements such as ``nav`` or ``footer``, and class, id or role names such as ``sidebar``
are more evidence (``hints``), which moves a label by one step: in furniture a good block becomes ambiguous (with a weak word such as ``related``: unless it is
long) and an ambiguous one bad.  Where most of the good text lies in articles, good blocks outside become ambiguous.  What such an element marks is one section: its ambiguous
blocks look for neighbours within it; where nothing in it is decided, an article's are good and all others bad.  Where a page has no article and no good block, but a
long one in a section that a name marked, that name was wrong, and the passes run again without it.

Names in parts (``top-menu``, ``commentList``) are evidence only if each part is furniture or says nothing
(``list``, ``box``): ``side-effects`` and ``search-results`` are none.

Defined cases: null, empty or textless html gives an empty text; tags that are never closed end
with their parents, and end tags of what isn't open are nothing; a link goes on over blocks within it, and ends with the block that it was opened in; comments, scripts and tags that break off at the end of the page are markup;
repeated rows give repeated results; an empty table gives an empty result.  Time is linear in the page.  Only the id,
url and html columns are read, so that others can't clash.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is it that for was on are as with be by at from this have or an not his her they you which had their "
    "le la les de des du et en un une est que qui dans pour pas sur au par plus ne se ce il elle avec son sa aux mais ou "
    "der die das und ist nicht von mit den dem ein eine zu im für auf sich des auch als es an werden aus er hat dass sie nach bei "
    "el los las y del por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)
#: Elements that hold page furniture, and those without any text of their own.
SKIPPED = frozenset("nav footer aside form button select textarea dialog menu iframe object canvas svg head title label fieldset".split())
RAW = "script|style|noscript|template|textarea|title|svg|iframe"
#: Elements that stay within a line.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset(("article", "main"))
#: Words of class, id and role values that mark page furniture, those that do so less surely, and those that say nothing.
FURNITURE = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside complementary contentinfo ad ads adv advert advertisement sponsor sponsored promo cookie cookies consent popup modal "
    "newsletter subscribe signup login comment comments disqus respond reply replies breadcrumb breadcrumbs pagination pager disclaimer".split()
)
WEAK = frozenset("header side banner notice alert overlay form search share sharing social related recommended toolbar widget copyright legal".split())
NEUTRAL = frozenset(
    "site page main top bottom left right list item items box wrap wrapper container block section area inner outer body bar links link group row col column slot unit text post posts article articles primary secondary global".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Fixed value: what marks a short block outside of articles as a legal notice.
COPYRIGHT = "©"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-z/!?][^>]*\Z",
    re.S | re.I,
)
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class BlockRules:
    max_link_density: float = 0.4
    short_chars: int = 70
    long_chars: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.28
    #: Whether elements and names are evidence.
    hints: bool = True


#: What a section is: furniture by its element, by its name, perhaps furniture, nothing, an article.
BY_ELEMENT, BY_NAME, PERHAPS, PLAIN, ARTICLE = range(5)


@dataclass
class Block:
    text: str
    link_chars: int
    section: int  # 0 outside of all sections
    kind: int
    heading: bool
    good: bool | None = None


def _named(attributes: str) -> int:
    """What the class, id and role of an element say of it."""
    found = PLAIN
    for m in _HINT.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {x.lower() for x in _PART.findall(name)} - NEUTRAL
            if parts and parts <= FURNITURE:
                return BY_NAME
            if parts and parts <= FURNITURE | WEAK:
                found = PERHAPS
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, section, what that is
    held: list[str] = []
    opened: Counter[str] = Counter()  # elements on the stack by name
    links = 0  # characters within links
    link: tuple[int, str] | None = None  # of an open link: the depth, and the open-ended element around it
    around = ""
    heading, sections = False, 0

    def within() -> tuple[int, int]:
        return stack[-1][1:] if stack else (0, PLAIN)

    def flush() -> None:
        nonlocal links
        text = " ".join(html_lib.unescape("".join(held)).split())
        if text:
            out.append(Block(text, links, *within(), heading))
        held.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            held.append(text)
            if link:
                links += len("".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[2] or m[5])
        if name == "a":
            link = None if closing else (len(stack), around)
            continue
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if name in HEADINGS:
            heading = not closing
        elif name == "p" or name in VOID:
            heading = False
        # these may stay open without an end tag: they are on the stack only where their names say something
        open_ended = name in HEADINGS or name in ("p", "li", "dt", "dd", "tr", "td", "th", "option")
        if name in VOID:
            continue
        if link and link[1] and (name == link[1] if closing else True):
            link = None  # what it was opened in ends
        around = name if open_ended and not closing else ""
        if closing:
            while opened[name] and (not open_ended or stack[-1][0] == name):
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            if link and len(stack) < link[0]:
                link = None
            continue
        if name in REGIONS or name == "body":
            while stack and stack[-1][0] in ("head", "nav", "ul", "ol", "menu"):
                opened[stack.pop()[0]] -= 1  # left open
        section, kind = within()
        own = PLAIN if name in ("html", "body") else _named(m[4] or m[7] or "")
        if name in SKIPPED or (name == "header" and kind != ARTICLE):
            own = BY_ELEMENT
        elif name in REGIONS and own == PLAIN:
            own = ARTICLE
        if open_ended and own == PLAIN:
            continue
        # furniture within an article is a section of its own; an article within furniture is not
        if own != PLAIN and (own < kind or kind == PLAIN or own == kind == ARTICLE):
            sections += 1
            section, kind = sections, own
        stack.append((name, section, kind))
        opened[name] += 1
    add(page[at:])
    flush()
    return out


def _stop_share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(b: Block, rules: BlockRules, kind: int) -> bool | None:
    """The label of a block by itself, where ``kind`` is its section's."""
    n, low = len(b.text), b.text.lower()
    if b.link_chars / n > rules.max_link_density or (COPYRIGHT in low and n < rules.long_chars and kind != ARTICLE):
        return False
    stops = _stop_share(_WORD.findall(low))
    good = True if not b.heading and (stops >= rules.stop_low and n >= rules.long_chars or stops >= rules.stop_high and n >= 2 * rules.short_chars) else None
    if kind <= BY_NAME or (kind == PERHAPS and n < rules.long_chars):
        good = None if good else False
    return good


def label_blocks(found: list[Block], rules: BlockRules = BlockRules()) -> None:
    """Both passes; sets ``good`` of each block."""
    kinds = [b.kind if rules.hints else PLAIN for b in found]
    first = [first_pass(b, rules, k) for b, k in zip(found, kinds)]
    if not any(first) and ARTICLE not in kinds:
        long = {b.section for b, k in zip(found, kinds) if k == BY_NAME and len(b.text) >= rules.long_chars and first_pass(b, rules, PLAIN)}
        kinds = [PLAIN if b.section in long else k for b, k in zip(found, kinds)]
        first = [first_pass(b, rules, k) for b, k in zip(found, kinds)]
    where = [b.section if k != PLAIN else 0 for b, k in zip(found, kinds)]
    inner, outer = (sum(len(b.text) for b, k, f in zip(found, kinds, first) if f and (k == ARTICLE) == x) for x in (True, False))
    if inner > outer:
        first = [None if f and k != ARTICLE else f for k, f in zip(kinds, first)]
    members: dict[int, list[int]] = {}
    for i, s in enumerate(where):
        members.setdefault(s, []).append(i)
    for s, at in members.items():
        if s == 0:
            label_plain(found, first, at, rules, inner <= outer)
            continue
        # the nearest decided blocks before and behind, within the section
        before, last = [], None
        for i in at:
            before.append(last)
            last = (i, first[i]) if first[i] is not None else last
        last = None
        for i, up in zip(reversed(at), reversed(before)):
            found[i].good = first[i] if first[i] is not None else _inherited(i, up, last, found[i], kinds[i])
            last = (i, first[i]) if first[i] is not None else last


@dataclass
class Part:
    """A section of a page without hints: the blocks from a heading, or from behind a bad block, to the next one."""

    blocks: list[int]
    headed: bool
    good: bool | None = None
    chars: int = 0


def cut_sections(found: list[Block], first: list[bool | None], at: list[int]) -> list[Part]:
    """The sections among the blocks ``at``, in order; each bad block is one of its own."""
    parts: list[Part] = []
    open_part, bare = False, False  # whether a block may join the last section; whether that has headings only
    for i in at:
        b = found[i]
        if first[i] is False:
            parts.append(Part([i], False, False, len(b.text)))
            open_part = False
            continue
        if not open_part or (b.heading and not bare):
            parts.append(Part([], b.heading))
            open_part, bare = True, b.heading
        bare = bare and b.heading
        parts[-1].blocks.append(i)
        parts[-1].chars += 0 if b.heading else len(b.text)
        parts[-1].good = parts[-1].good or first[i]
    return parts


def label_plain(found: list[Block], first: list[bool | None], at: list[int], rules: BlockRules, judge: bool) -> None:
    """The second pass over blocks that no element or name marks; without ``judge`` no section is judged as a whole, as the text is elsewhere."""
    parts = cut_sections(found, first, at)
    for part in parts if judge else []:
        if part.good is None and part.chars >= (rules.short_chars if part.headed else rules.long_chars):
            if _stop_share(_WORD.findall(" ".join(found[i].text.lower() for i in part.blocks))) >= rules.stop_low:
                part.good = True
    if judge and not any(p.good for p in parts):
        largest = max((p for p in parts if p.good is None and p.headed and p.chars), key=lambda p: p.chars, default=None)
        if largest:
            largest.good = True
    # the nearest decided section above and below, in blocks
    decided = [p.good for p in parts]
    up, ups = None, []
    for p, good in zip(parts, decided):
        ups.append(up)
        if good is not None:
            up = (0, good)
        elif up:
            up = (up[0] + len(p.blocks), up[1])
    down, headed = None, False
    for p, good, above in zip(reversed(parts), reversed(decided), reversed(ups)):
        if good is None and not p.chars:
            good = bool(down and down[1])  # a heading goes with what follows
        elif good is None:
            near = [x for x in (above, None if headed else down) if x]
            good = bool(near) and min(near, key=lambda x: x[0])[1]
        if p.good is not None:
            down = (0, p.good)
        elif down:
            down = (down[0] + len(p.blocks), down[1])
        headed = p.headed
        for i in p.blocks:
            found[i].good = good


def _inherited(i: int, up: tuple[int, bool] | None, down: tuple[int, bool] | None, b: Block, kind: int) -> bool:
    """The label of an ambiguous block from the decided ones before (``up``) and behind it."""
    if up is None or down is None:
        near = up or down
        return near[1] if near else kind == ARTICLE
    if up[1] == down[1]:
        return up[1]
    if i - up[0] != down[0] - i:
        return up[1] if i - up[0] < down[0] - i else down[1]
    # headings go with what follows; a tie within an article stays
    return down[1] if b.heading else kind == ARTICLE


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    found = blocks(page)
    label_blocks(found, rules)
    return "\n".join(b.text for b in found if b.good)


def extract_pages(pages: DataFrame, rules: BlockRules = BlockRules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x, rules) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    columns = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h")]
    return map_batches(pages.select(*columns), run, "page_id long, url string, text string, n_chars long")
