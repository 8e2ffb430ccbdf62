"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each block
by itself: link density, membership in a menu, header, footer, sidebar, notice,
advert, form or comment container, length, and density of stop words make it
good, bad, or leave a short one undecided. Stop words are those of four
languages: long blocks without them are bad only where blocks with them hold at
least as much of the page, they are written in Latin letters, and the nearest
decided blocks are not good on both sides; otherwise length and link density
decide. In the second pass undecided blocks
inherit the label of the nearest decided neighbours in their own region (an
article, or the rest of the page); where two neighbours disagree the nearer one
counts, the earlier on a tie. A region without decided blocks is good if it is
an article or main element. If articles hold a block that is good by itself, or at
least as much good text as the rest of the page, blocks outside all articles are
bad; otherwise those inside are. An article named as a reader's comment or an
advert is none. A page on which nothing is good is judged again without the names
of side columns, which wrappers of whole pages bear as well.

Entities are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by a line feed. Null, empty or malformed html never fails: a
null or empty page has the empty text, unclosed tags end with the page, and an
unclosed script or style hides the rest. Whole pages are read, of any length.
Copies get the same text; an empty table gives an empty one; other columns are
kept and a column named like the output is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import parts

STOP_WORDS = frozenset(
    """
    the of and to a in is it that for on was with are by as at be this from or an he you not but his her they we have had which
    le la les de des du et un une en est que qui dans pour sur avec au aux par ce il elle ne pas se sont plus ou
    der die das und ist in den von zu mit für auf ein eine einer nicht sich des dem es er sie im auch als an war
    el la los las de y en que un una es por con para del se al lo no su como más pero sus o este
    """.split()
)
#: Quotes count after an equals sign only. Nothing is tried twice: a tag ends at its > or gives up at the next <, so that
#: a page takes time in proportion to its length whatever is left open.
ATTRIBUTE_TEXT = r"""((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^<>])*+)>"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|svg|title)\b{ATTRIBUTE_TEXT}.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+){ATTRIBUTE_TEXT}|<[!?][^<>]*+>",
    re.S | re.I,
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose nesting is followed; the others need no end tag to be understood.
NESTED = frozenset("article aside body details dialog div dl fieldset figure footer form header head main menu nav ol section table ul button span a".split())
REGIONS = frozenset({"article", "main"})
NOT_TEXT = frozenset("nav aside footer form menu dialog head button".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NOT_TEXT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget menu nav navbar
    navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter
    subscribe signup social share sharing related recommended comment comments disqus replies pagination pager copyright disclaimer""".split()
)
HEADER_NAMES = frozenset({"header", "topbar"})
#: Names of articles that are not the page's: what readers or advertisers have written.
READER_NAMES = frozenset("ad advert advertisement sponsored promo promotion comment comments disqus reply replies".split())
#: Names of side columns, which wrappers of whole pages bear as well.
COLUMN_NAMES = frozenset("sidebar widget".split())
#: Blocks of these are text even if all of it is a link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
#: Parts of a name beside one of those above that leave its meaning; with any other part, as in related-work, it is another name.
NEUTRAL_NAMES = frozenset(
    """site page global main top bottom left right center upper lower inner outer section area box list block bar link links item items row
    slot unit post posts article articles content text form icons buttons button group module panel primary secondary mobile desktop
    story stories thread user reader readers login contact legal info""".split()
)
#: Names that say a container merely has such a part.
LAYOUT_NAMES = frozenset("has with no without wrapper container layout page".split())
#: Label of long blocks outside articles that no stop word tells of.
UNKNOWN = "?"
ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Rules:
    short: int = 70
    long: int = 200
    stop_low: float = 0.08
    stop_high: float = 0.20
    links: float = 0.34


@dataclass
class Block:
    text: str
    region: int
    excluded: bool
    linked: int
    prose: bool = False  # of a paragraph or heading
    stopped: bool = False  # long, with stop words
    label: str = field(default="")


def names_exclude(tag: str, attributes: str, in_region: bool, columns: bool) -> bool:
    """columns: whether names of side columns count."""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for key, a, b, c in ATTRIBUTES.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role":
            if value in NOT_TEXT_ROLES:
                return True
        elif key != "aria-hidden":
            listed = READER_NAMES if tag == "article" else NOT_TEXT_NAMES if in_region else NOT_TEXT_NAMES | HEADER_NAMES
            for full in value.split():
                names = {x for x in re.split(r"[^a-z]+", full) if x}
                if names & listed and not names & LAYOUT_NAMES and names <= listed | NEUTRAL_NAMES and (columns or not names & COLUMN_NAMES):
                    return True
    return False


def blocks(page: str, columns: bool = True) -> Iterator[Block]:
    """Blocks with text, in page order; region 0 is what no article or main element holds."""
    stack: list[tuple[str, int, bool]] = []  # name, region, excluded
    depth: Counter = Counter()  # open elements of each name
    region, excluded, regions, link = 0, False, 0, 0
    parts: list[tuple[str, bool]] = []
    at, breaks, prose = 0, 0, False

    def close() -> Iterator[Block]:
        if parts:
            text = " ".join("".join([t for t, _ in parts]).split())
            if text:
                yield Block(text, region, excluded, sum(len("".join(t.split())) for t, inside in parts if inside), prose)
            parts.clear()

    def take(raw: str) -> None:
        nonlocal breaks
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append((text, link > 0))
            if not text.isspace():
                breaks = 0

    for m in TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            if m[1] is not None:
                parts.append((" ", False))
            continue
        name, end = name.lower(), bool(m[3])
        if name == "br":
            parts.append((" ", False))
            breaks += 1
            if breaks == 2:
                yield from close()
            continue
        if name in BLOCKS:
            yield from close()
            prose = not end and name in PROSE
        if name == "a":
            link = 0 if end else 1
        elif name in NESTED:
            if end:
                if depth[name]:  # the end tag of nothing does not search the stack
                    before, closed = excluded, ""
                    while closed != name:
                        closed = stack.pop()[0]
                        depth[closed] -= 1
                    if name not in BLOCKS and before != (stack[-1][2] if stack else False):
                        yield from close()
            elif not m[5].endswith("/"):
                inside = region
                out = excluded or name in NOT_TEXT or name == "header" and not region or names_exclude(name, m[5], region > 0, columns)
                if name in REGIONS and not excluded and not region:
                    regions += 1
                    inside = regions
                if out != excluded and name not in BLOCKS:
                    yield from close()
                stack.append((name, inside, out))
                depth[name] += 1
            region, excluded = stack[-1][1:] if stack else (0, False)
    take(page[at:])
    yield from close()


def first_pass(b: Block, rules: Rules) -> str:
    n = len(b.text)
    words = b.text.lower().split()
    visible = sum(map(len, words))
    if b.excluded or "©" in b.text and n < rules.short and not b.region:
        return "bad"
    # in an article a block of links alone is a menu unless it is a paragraph
    if b.linked >= visible and not b.prose if b.region else b.linked > rules.links * visible:
        return "bad"
    density = sum(w.strip(".,;:!?\"'()[]%#*&$") in STOP_WORDS for w in words) / len(words)
    if n < rules.short:
        return ""
    b.stopped = density >= rules.stop_low
    if density >= rules.stop_high or n >= rules.long and density >= rules.stop_low:
        return "good"
    # Long without stop words: its neighbours decide in an article, elsewhere the language of the page.
    return "" if b.region or b.stopped else UNKNOWN


def latin(text: str) -> bool:
    alphabetic = [c for c in text if c.isalpha()]
    return 2 * sum(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in alphabetic) >= len(alphabetic)


def judge_unknown(found: list[Block]) -> None:
    """Blocks without stop words are text on a page of no known language; on others lists of names or junk, unless text stands before and after."""
    unknown = [i for i, b in enumerate(found) if b.label == UNKNOWN]
    known = sum(len(b.text) for b in found if b.stopped) >= sum(len(found[i].text) for i in unknown)
    before, after = ["bad"] * len(found), ["bad"] * len(found)  # labels of the nearest decided blocks
    for near, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last = "bad"
        for i in order:
            near[i] = last
            if found[i].label in ("good", "bad"):
                last = found[i].label
    for i in unknown:
        within = before[i] == after[i] == "good"
        found[i].label = "bad" if known and latin(found[i].text) and not within else "good"


def second_pass(found: list[Block], regions: dict[int, list[int]]) -> None:
    for region, members in regions.items():
        if region and not any(found[i].label == "good" for i in members):  # nothing in the article tells its short blocks from text
            for i in members:
                found[i].label = found[i].label or "good"
        before: int | None = None
        decided = [k for k, i in enumerate(members) if found[i].label and not found[i].excluded]
        labels = [found[i].label for i in members]
        at = 0
        for k, i in enumerate(members):
            if labels[k]:
                continue
            while at < len(decided) and decided[at] < k:
                before = decided[at]
                at += 1
            after = decided[at] if at < len(decided) else None
            if before is None and after is None:
                found[i].label = "good" if region else "bad"
            else:
                nearest = before if after is None or before is not None and k - before <= after - k else after
                found[i].label = labels[nearest]
                if region and labels[nearest] == "bad" and any(labels[x] == "good" for x in (before, after) if x is not None):
                    found[i].label = "good"


def main_text(page: str | None, rules: Rules | None = None) -> str:
    if not page:
        return ""
    rules = rules or Rules()
    good = judged(list(blocks(page)), rules)
    if not good:  # perhaps a wrapper of the whole page is named after its side column
        good = judged(list(blocks(page, columns=False)), rules)
    return "\n".join(b.text for b in good)


def judged(found: list[Block], rules: Rules) -> list[Block]:
    """The good blocks: those of articles, unless these hold but short ones and less text than the rest of the page."""
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        b.label = first_pass(b, rules)
        regions.setdefault(b.region, []).append(i)
    sure = any(b.region and b.label == "good" for b in found)
    judge_unknown(found)
    second_pass(found, regions)
    good = [b for b in found if b.label == "good"]
    size = lambda inside: sum(len(b.text) for b in good if bool(b.region) == inside)
    inside = size(True) > 0 and (sure or size(True) >= size(False))
    return [b for b in good if bool(b.region) == inside]


def extract(df: DataFrame, html: str = "html", out: str = "text", rules: Rules | None = None) -> DataFrame:
    """df with the main text of each page; one pass, no shuffle."""

    @arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts(batches):
            yield pa.array([main_text(x.as_py(), rules) for x in a], pa.string())

    return df.withColumn(out, texts(F.col(html)))
