"""Main text of HTML pages by two passes of block rules.

A page is cut at block tags. Blocks inside navigation, forms and the like, or inside elements
whose class, id or role can only name such a part ("cookie-bar", "related-posts"), are bad. A name that
might also be a subject ("related-work", "social-history": a mark beside a word that isn't one of layout)
counts in pass 1 only. Of the other blocks:

1. *good*: at least ``MIN_GOOD`` characters, ``STOP_DENSITY`` of the words are stop words and links
   hold at most ``MAX_LINKS`` of the characters; *bad*: links hold more than that, or the block isn't good
   and inside an element with a doubtful name; all others are ambiguous. So are linked headings, table cells, captions and
   list items of an article or main, but not ``LINK_RUN`` and more linked list items in a row.
2. An ambiguous block takes the label of the nearest decided block of the same container (the
   innermost article or main, else the page); of two equally near, good wins. In a
   container without decided blocks it is good if that is an article or main, else bad.

Stop words exist for four languages. Where blocks with enough of them hold less than half of a
container's text in long blocks with few links, as in any other language, length and links alone make
a block good. In an article or main without any good block (short blocks, lists, code) all blocks with few
links are good. So are, where a page comes to nothing else, its headings, paragraphs, items and cells with few links; bare text
outside of such elements isn't.

Scripts, pictures, buttons and other elements that stand inside a line go without cutting it; formulas and labels stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MIN_GOOD = 70
STOP_DENSITY = 0.2
MAX_LINKS = 0.4
LINK_RUN = 3

#: frequent function words of the languages that the rules know
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its more no not of on one only or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you
aber als am an auch auf aus bei bin bis da dann das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur ob oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur tu un une vous y
al como con de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy ni no nos o para pero por que quien se ser si sin sobre son su sus también un una uno y ya
""".split())  # fmt: skip

#: elements whose whole content is never main text
DROPPED = frozenset("head script style noscript template svg nav footer aside form button select textarea option fieldset iframe object audio video canvas menu dialog".split())
#: those of them that stand inside a line
INLINE = frozenset("script style noscript template svg button select textarea option iframe object audio video canvas".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul xmp".split())
CONTAINERS = frozenset(("article", "main"))
KINDS = {"head": "h1 h2 h3 h4 h5 h6", "cell": "td th caption figcaption", "item": "li dt dd", "text": "p pre blockquote"}
KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}
#: parts of class, id and role names that mark boilerplate
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
MARKS = COMMENTS | frozenset("ad ads adbox adslot adunit adwrap advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navi menu menus breadcrumb breadcrumbs footer sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search form pagination pager skip toolbar masthead complementary contentinfo".split())
#: marks that are also subjects; they are sure only where the rest of the name is marks and words of layout
DOUBTFUL = frozenset("alert aside banner comment complementary form login menu menus notice notices overlay overlays popup promotion promo recommended related reply replies respond search share sharing side skip social sponsor sponsored subscription toolbar widget".split())
LAYOUT = frozenset("area areas article articles author bar bars block blocks body bottom box boxes btn button buttons card cards center col cols column columns container content count date desktop div entry entries feed field first follow form global grid group head header heading hero holder icon icons id in inner input item items js label last layer layout left level line link links list lists main me media message meta mobile modal module modules more my new news on outer page pages pane panel panels post posts primary right role row rows secondary section sections site slot small stack sticky stories story strip sub text thread tile tiles title toggle top trigger ui unit up us user view wrap wrapper wrapping zone".split())
#: words that turn such a part into a remark on the layout ("has-sidebar", "comments-open")
NOT_AFTER = frozenset("has with no without".split())
NOT_BEFORE = frozenset("open closed enabled disabled".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[^\W\d_]+")


def marked(attributes: str, marks: frozenset[str] = MARKS) -> int:
    """Whether class, id or role names a part that isn't main text: 2 surely, 1 perhaps, 0 not."""
    found = 0
    if "=" not in attributes:
        return found
    for m in NAMES.finditer(attributes):
        for name in "".join(m.groups("")).split():
            parts = PARTS.findall(CAMEL.sub(" ", name).lower())
            plain = all(part in MARKS or part in LAYOUT for part in parts)
            for k, part in enumerate(parts):
                if part in marks and not (k and parts[k - 1] in NOT_AFTER) and not (k + 1 < len(parts) and parts[k + 1] in NOT_BEFORE):
                    found = max(found, 1 if part in DOUBTFUL and not plain else 2)
    return found


def blocks(page: str) -> list[tuple[str, int, int, int, bool, bool, str]]:
    """(text, characters in links, container number, kind of container: 1 article or main, dropped, doubtful, kind) of each block."""
    out, parts, link_chars = [], [], 0
    containers, stack = [(0, 0)], []  # open containers; open dropped element: [name, depth, reader comments]
    opened: list[str] = []  # open block elements
    doubt = ["", 0]  # outermost open element with a doubtful name, and its depth
    links = count = at = 0

    def within() -> bool:
        """In a dropped element of the line."""
        return bool(stack) and stack[-1][0] in INLINE

    def kind() -> str:
        found = [KIND[x] for x in opened[-3:] if x in KIND]
        return next((k for k in ("cell", "item") if k in found), found[-1] if found else "")

    def text(s: str) -> None:
        nonlocal link_chars
        if s and not within():
            s = entities.unescape(s) if "&" in s else s
            parts.append(s)
            if links:
                link_chars += len("".join(s.split()))

    def close() -> None:
        nonlocal parts, link_chars
        line = " ".join("".join(parts).split())
        if line:
            out.append((line, link_chars, *containers[-1], bool(stack), doubt[1] > 0, kind()))
        parts, link_chars = [], 0

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW and not end:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            if name != "xmp":
                continue
            close()
            parts.append(page[m.end() : at])
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = max(0, links - 1) if end else 1
        if (name in BLOCK or name in DROPPED and name not in INLINE) and not within():
            close()
            if name in BLOCK and name not in VOID:
                if not end:
                    if opened and opened[-1] in KIND and (name == opened[-1] or opened[-1] == "p"):
                        opened.pop()  # closed by this one
                    opened.append(name)
                elif name in opened:
                    del opened[len(opened) - 1 - opened[::-1].index(name) :]
            links = 0 if name in BLOCK and name != "li" and end else links
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if stack:
            if name == stack[-1][0]:
                stack[-1][1] += -1 if end else 1
                if not stack[-1][1]:
                    stack.pop()
            elif end and name in ("body", "html", "head"):
                stack.clear()
            elif not end and (name in ("body", "main") or name == "article" and not stack[-1][2] and marked(attributes, COMMENTS) < 2):
                stack.clear()  # the dropped part was never closed, or only wraps the article
            if stack:
                continue
        elif not end:
            sure = marked(attributes, COMMENTS if name in CONTAINERS else MARKS) if name not in ("html", "body") else 0
            if sure == 2 or name in DROPPED or name == "header" and len(containers) == 1:
                stack.append([name, 1, marked(attributes, COMMENTS) == 2])
                continue
            if sure and not doubt[1]:
                doubt = [name, 0]
        if name in CONTAINERS and not end:
            doubt = ["", 0]
        elif name == doubt[0]:
            doubt[1] += -1 if end else 1
            if doubt[1] <= 0:
                doubt = ["", 0]
        if name in CONTAINERS:
            if not end:
                count += 1
                containers.append((count, 1))
            elif len(containers) > 1:
                containers.pop()
    close()
    return out


def linked(line: str, link_chars: int) -> bool:
    return link_chars > MAX_LINKS * len(line.replace(" ", ""))


def label(line: str, link_chars: int, known: bool = True, soft: bool = False) -> int:
    """1 good, -1 bad, 0 ambiguous; stop words count in a ``known`` language only; links alone don't make a ``soft`` block bad."""
    if linked(line, link_chars):
        return 0 if soft else -1
    if len(line) >= MIN_GOOD:
        if not known:
            return 1
        words = WORD.findall(line.lower())
        if words and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words):
            return 1
    return 0


def softened(found: list[tuple]) -> list[bool]:
    """Whether a block of an article or main is a heading, cell or item, but for runs of linked items."""
    out, run = [], 0
    for i, b in enumerate(found):
        out.append(b[3] == 1 and b[6] in ("head", "cell", "item"))
        run = run + 1 if b[6] == "item" and linked(*b[:2]) else 0
        if run >= LINK_RUN:
            out[i - run + 1 :] = [False] * run
    return out


def inherit(labels: list[int], default: bool) -> list[bool]:
    """Ambiguous blocks take the nearest decided label."""
    n, far = len(labels), len(labels) + 1
    left, right = [(far, 0)] * n, [(far, 0)] * n
    for order, side in ((range(n), left), (range(n - 1, -1, -1), right)):
        seen = (far, 0)
        for i in order:
            seen = (0, labels[i]) if labels[i] else (seen[0] + (seen[0] < far), seen[1])
            side[i] = seen
    out = []
    for (a, x), (b, y) in zip(left, right):
        out.append(default if not x and not y else (x if a < b or not y else y if b < a or not x else max(x, y)) > 0)
    return out


def main_text(page: str | None) -> str:
    """Good blocks in page order, one a line; empty for a null or empty page."""
    found = [b for b in blocks(page or "") if not b[4]]
    by: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(found):
        by.setdefault((b[2], b[3]), []).append(i)
    keep = [False] * len(found)
    soft = softened(found)
    for (_, kind), ids in by.items():
        labels, long = ([label(*found[i][:2], known=known, soft=soft[i]) or -found[i][5] for i in ids] for known in (True, False))
        size = lambda of: sum(len(found[i][0]) for i, x in zip(ids, of) if x == 1)
        labels = labels if 2 * size(labels) >= size(long) > 0 else long
        for i, good in zip(ids, inherit(labels, False) if 1 in labels else [kind == 1 and x == 0 for x in labels]):
            keep[i] = good
    if not any(keep):
        keep = [bool(b[6]) and not b[5] and not linked(*b[:2]) for b in found]
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


@F.pandas_udf(StringType())
def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([main_text(p) for p in part], dtype=object)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row; text is empty where nothing is main text.

    Null html counts as empty; null ids and urls stay null; repeated rows stay; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    return pages.select("page_id", "url", extract("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
