"""HTML extraction: flat text blocks, classified by a decision tree over their and their neighbours' features.

A page is cut into flat blocks at block-level tags. Each block has its word count, its link density (words
inside ``a`` against all), those of the block before and after, and flags for the elements it lies in. A
decision tree, grown here on the small labelled table below, keeps or rejects every block; nothing is
dropped by length or position. Whole pages are read in one pass with a bounded number of rows at a time.

Class names hint at boilerplate in all that an element holds, but a name on an article or on what a page calls its
main part, or on a wrapper around it, only if the whole name is one of boilerplate (``OTHER``), and around ``main`` never.
Inside an article a part of a name is no hint either: there the whole name must be one of boilerplate (``WHOLE``), and that of a
paragraph, heading or list item one of few (``INSERTS``). A form, or an element whose name only holds a word of boilerplate, may
be a wrapper around the whole page (``_wraps``): if most of the page's words lie in it, as paragraphs, it taints none of them.
Text of buttons and labels is dropped where it stands.

Markup is found in one pass, in time that grows with the page's length whatever its faults: a quote that is never
closed is read as text of its tag, once for the whole page; an element whose content is no text (``RAW``) ends with its own tag
if it closes itself or is never closed, but an unclosed script or style with the page; a ``<`` that starts no markup is text.

Edge cases: null or empty html gives an empty text; broken character references stay as they are; an
unclosed element ends with its parent or with the page, an unclosed comment with the page, and a last tag that is cut off is no
text; text outside any element is a block like others; repeated rows get equal texts, and an empty table an empty result;
of shares that tie in the tree content wins; columns named like results are replaced, others stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import give_back, without

#: Elements whose content is no text of the page.
RAW = frozenset("script style template textarea title noscript select svg iframe object canvas annotation annotation-xml".split())
#: Those that end with the page if they are never closed: what follows is code.
CODE = frozenset(("script", "style"))
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: Inside a tag: a value that a quote opens, or the tag's end. A cut-off tag: its name and nothing more, or an attribute.
NEXT = re.compile(r"""=\s*(["'])|>""")
CUT_OFF = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s*/?\Z|\s+[^\s=<>]+\s*(?:=|\Z))")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
AWAY = frozenset("nav footer aside header form menu dialog fieldset".split())
#: Elements whose text is dropped, even in the middle of a block.
DROPPED = frozenset(("button", "label"))
HOME = frozenset("article main".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|popup|modal|side-?bar|widget|menu|nav\w*|breadcrumbs?|footer|(?:site|page|top|global)[_-]?header|head-?bar|masthead|topbar"
    r"|share|social|related|recommend\w*|comments?|commentlist|respond|replies|disqus|newsletter|subscri\w*|login|search|copyright|legal|tags?)(?:$|[\s_-])",
    re.I,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Names of layouts, which say what a page has beside an element, not what the element is.
LAYOUT = re.compile(r"(?:has|with|without|no|is)[_-]", re.I)
#: Where a page names its main part; and class names that say what a whole element, even an article, is: not the page's own text.
ROOF = re.compile(r"""(?<![\w-])(?:id|role)\s*=\s*["']?(?:main|content|main[_-]?content)["']?(?:[\s/]|$)""", re.I)
OTHER = re.compile(
    r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|popup|modal|side-?bar|widget|menu|nav\w*|footer|related|recommend\w*|comments?|commentlist|respond|replies|disqus|newsletter)"
    r"(?:[_-](?:lists?|body|area|section|box|posts?|articles?|items?|stories|content))?",
    re.I,
)
_WORDS = r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|popup|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|disqus|notice|breadcrumbs?"
_BEFORE, _AFTER = r"(?:(?:post|article|entry|page|site|top|bottom|inline|google|social|js|c)[_-]{1,2})?", r"(?:[_-]{1,2}(?:lists?|body|area|section|box|posts?|articles?|items?|stories|content|buttons?|links?|bar|slot|sign-?up|form|block|container|wrap(?:per)?|unit|banner|footer|header|icons?|widget|inner|label|text|title|top|bottom|\d+))*"
#: Class names that hint at boilerplate inside an article: of any element, and of paragraphs, headings and list items.
WHOLE = re.compile(rf"{_BEFORE}{_WORDS}|modal|side-?bar|widget|menu|nav\w*|footer|masthead|login|search|copyright|legal|tags?){_AFTER}", re.I)
INSERTS = re.compile(rf"{_BEFORE}{_WORDS}){_AFTER}", re.I)
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figure figcaption span a b i em strong".split())
SPACE = re.compile(r"\s+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "away", "hint", "home", "heading")


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each piece of markup, in one pass; the name is empty of comments, declarations and raw elements."""
    at, last = 0, page.rfind(">")
    strict = True  # do quotes hold tags together? Not after one that is never closed.
    unclosed: set[str] = set()  # raw elements that close nowhere further on
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            yield start, end, "", False, ""
            at = end
            continue
        if start > last:
            if CUT_OFF.match(page, start):
                yield start, len(page), "", False, ""
                return
            at = start + 1
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            yield start, at, "", False, ""
            continue
        m = NAME.match(page, start)
        if not m:
            at = start + 1
            continue
        end = _tag_end(page, m.end()) if strict else page.find(">", m.end()) + 1
        if not end:
            strict, end = False, page.find(">", m.end()) + 1
        name, attributes = m[2].lower(), page[m.end() : end - 1]
        if name in RAW:
            if not m[1] and not (attributes.endswith("/") and name not in CODE):
                stop = None if name in unclosed else _closing(name).search(page, end)
                close = page.find(">", stop.end()) + 1 if stop else 0
                if close:
                    end = close
                else:
                    unclosed.add(name)
                    if name in CODE and not attributes.endswith("/"):
                        end = len(page)
            name = ""
        yield start, end, name, bool(m[1]), attributes
        at = end


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``, quoted values passed over; 0 if a quote or the tag is never closed."""
    while m := NEXT.search(page, at):
        if not m[1]:
            return m.end()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return 0
    return 0


@lru_cache(32)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, bool]]:
    """Flat blocks in page order: (text, words, words inside links, away, hint, home, heading)."""
    out: list[tuple] = []
    stack: list[tuple] = []
    counts = {"away": 0, "hint": 0, "other": 0, "home": 0, "a": 0, "heading": 0, "drop": 0}
    soft: dict[str, list[int]] = {"away": [], "hint": []}  # open elements that may be wrappers, by number
    wrappers = 0
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                inside = sum(len(entities.unescape(x).split()) for x in linked)
                out.append((text, text.count(" ") + 1, inside, counts["away"], counts["hint"], counts["home"] > 0, counts["heading"] > 0, tuple(soft["away"]), tuple(soft["hint"])))
            parts.clear()
        linked.clear()

    def kinds(name: str, hint: bool, other: bool) -> list[str]:
        return [k for k, on in (("away", name in AWAY and not (name == "header" and counts["home"])), ("hint", hint), ("other", other), ("home", name in HOME), ("a", name == "a"), ("heading", name in ("h1", "h2", "h3", "h4", "h5", "h6")), ("drop", name in DROPPED)) if on]

    def pop() -> None:
        name, on, around, wrapper = stack.pop()
        open_[name] -= 1
        for k in on:
            counts[k] -= 1
        if wrapper:
            soft[wrapper].pop()
        if around:
            counts["hint"], counts["other"], soft["hint"] = around

    at = 0
    for start, end, name, closing, attributes in markup(page):
        if start > at:
            text = "" if counts["drop"] else page[at:start]
            parts.append(text)
            if counts["a"]:
                linked.append(text)
        at = end
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            depth = -1 if not open_[name] else next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0 and (name in BLOCKS or all(stack[i][0] not in BLOCKS for i in range(depth + 1, len(stack)))):
                while len(stack) > depth:
                    pop()
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in CLOSES_P:  # a paragraph ends where a block starts, and with it what it left open
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCKS), -1)
            if depth >= 0 and (stack[depth][0] == "p" or stack[depth][0] == name and name in ("li", "dt", "dd", "option", "tr", "td", "th")):
                while len(stack) > depth:
                    pop()
        hints = []
        if attributes and name not in ("html", "body"):
            named = [c for v in ATTR.findall(attributes) for c in v.strip("\"'").split() if HINT.search(c) and not LAYOUT.match(c)]
            fits = (INSERTS if name in LINES else WHOLE) if counts["home"] and name not in HOME else None
            hints = [c for c in named if fits is None or fits.fullmatch(c)]
        other = any(OTHER.fullmatch(c) for c in hints)
        around = None
        main = name == "main" or bool(attributes) and name in BLOCKS and name not in AWAY and ROOF.search(attributes) is not None
        if main or name == "article":
            around = counts["hint"], counts["other"], soft["hint"]
            soft["hint"] = []
            if main:
                counts["other"], hints, other = 0, [], False
            counts["hint"] = counts["other"]
            hints = hints if other else []
        on = kinds(name, bool(hints), other)
        for k in on:
            counts[k] += 1
        wrapper = "away" if name == "form" else "hint" if "hint" in on and not other else None
        if wrapper:
            wrappers += 1
            soft[wrapper].append(wrappers)
        stack.append((name, on, around, wrapper))
        open_[name] += 1
    if at < len(page) and not counts["drop"]:
        parts.append(page[at:])
        if counts["a"]:
            linked.append(page[at:])
    flush()
    fine = _wraps(out) if wrappers else ()
    some = lambda count, numbers: count > sum(k in fine for k in numbers)
    return [(*b[:3], some(b[3], b[7]), some(b[4], b[8]), *b[5:7]) for b in out]


def _wraps(found: list[tuple]) -> set[int]:
    """Numbers of forms and hinted elements that hold most of a page's words, as two paragraphs at least, or as one: a long one of a form, or all that no other element taints."""
    total, free = sum(b[1] for b in found), sum(b[1] for b in found if not b[3] and not b[4])
    words: Counter[int] = Counter()
    paragraphs: dict[int, list[int]] = {}
    for b in found:
        for k in (*b[7], *b[8]):
            words[k] += b[1]
            if b[1] >= 10 and 3 * b[2] < b[1]:
                paragraphs.setdefault(k, []).append(b[1])
    forms = {k for b in found for k in b[7]}
    one = lambda k: max(paragraphs[k]) >= 40 if k in forms else not free
    return {k for k, n in words.items() if 2 * n > total and k in paragraphs and (len(paragraphs[k]) > 1 or one(k))}


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURES for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        x[:, 0] = [b[1] for b in found]
        x[:, 1] = [b[2] / b[1] for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6:] = [b[3:7] for b in found]
    return x


#: The labelled table: a page a line, before it the labels of its blocks in page order (+ content, - boilerplate). {n} stands for n words.
LABELLED = """
-- <nav><a href=1>Home</a> <a href=2>News</a></nav><nav>Jump to</nav>
--++++- <nav><ul><li><a href=1>World affairs today</a></li></ul></nav><div class="ad">Buy now and save.</div><article><h1>The river rose again last night</h1><p>After three days of rain the river left its bed and the lower town stood under water until the morning came.</p><p>Indeed.</p><p>Nobody was hurt in the town, and the school will open on Monday as planned, the council said.</p></article><footer>Copyright of the publisher. All rights reserved.</footer>
-+++- <header><a href=1>Our site</a> all the news that fits</header><article><header><h1>Storm</h1></header><p>Be.</p><p>The mayor said that <a href=1>the dam</a> had held and that the worst was over for now, though more rain is due.</p></article><footer><a href=1>Imprint</a></footer>
+++-- <article><h1>On pumps</h1><p><a href=1>Read the full report of the water board</a></p><p>Pumps ran all night.</p><div class="share"><a href=1>Share</a> this with friends</div><aside>Related: <a href=1>Ten other floods</a></aside></article>
+-+-- <article><p>The harvest was late but it was good, and the barns are full from wall to wall this year.</p><div class="ad">Pumps for every cellar, now at half the price until the end of the week only.</div><p>Well.</p><footer>Filed under weather</footer><form>Write to the author</form></article>
+++-- <article><h1>Of bread</h1><p>Flour and water and salt, and time, are all that it takes to bake a good loaf at home.</p><p>Salt.</p></article><div class="comments"><p>I was there and it was far worse than they say, the water stood up to the first floor in our street.</p><p>Nice.</p></div>
-+-+-- <div class="banner">Subscribe to our letter for the best offers of the week and much more</div><article><p>Wood burns best when it has dried for two years under a roof with wind from the side.</p><div class="notice">Please accept the new terms of use before you read on, they apply from the next month</div><p>Ash.</p></article><section id="comments"><p>No.</p></section><div class="sidebar"><a href=1>Archive of all the years since we began</a></div>
-+++- <div id="cookie-notice">We use cookies. By going on you agree to their use on this site and others.</div><div><p>A plain page without an article element still has long paragraphs, and those are what a reader came for in the first place.</p><p>They hold many words and few links, and what stands beside them mostly is of their kind as well.</p><p>And one that cites <a href=1>a source</a> in the middle of a longer sentence about the matter.</p></div><div><a href=1>Sitemap</a> <a href=2>Contact</a> <a href=3>Help</a></div>
-++- <p><a href=1>Next page</a></p><p>It was a long way down to the lake, and the path was steep and wet from the rain.</p><p>Then a short one.</p><p><a href=1>Previous page</a></p>
++++-- <main><h2>Part two</h2><p>Main text in a main element may be as short as this or go on for a good while.</p><p>Yes.</p><p>It goes on.</p><nav><a href=1>Back</a></nav><div class="newsletter">Get it by mail every morning before breakfast</div></main>
++-- <div><p>The old mill still turns when the brook is high, and on some days they grind corn in it for show.</p><p>Most days it stands still and the ducks have it to themselves from dawn until the gates are shut.</p></div><footer>The mill is kept by a trust of the town, and the town is not liable for harm that comes to guests who climb on the wheel.</footer><div class="ad">Corn and flour from the mill, now sold in all good shops of the town and of the next one too.</div>
-++- <nav>You are here in the old part of our site, which we keep for those who have linked to it in the past</nav><p>The new mill by the road has no wheel, it runs on power from the grid and grinds all day.</p><p>It is loud, and the neighbours have often said so to the owner, who says that he hears nothing.</p><footer>Written by the mill club, printed by the town press, paid for by the readers of both of them.</footer>
-- <aside>Some of our readers have said that they would like to read more of this, and so there is now a page of it.</aside><div class="comments">It is true what they say of the mill, my father told me so too and he knew the man who built it.</div>
+++ <article><h1>Snow</h1><p>It fell all night and by the morning the road to the pass was shut, as it is each year at about this time.</p><p>Cold.</p></article>
+++ <main><p>Listen.</p><p>There is a sound in the walls of old houses at night that no one can put a name to, though all have heard it.</p><p>Yes.</p></main>
++++- <article class="post tag-rain share-enabled"><h2><a href=1>Rain again</a></h2><p>It has rained for a week now, and the lower meadows are as wet as they were in the spring of last year.</p><p>Sheep.</p><p><a href=1>The forecast</a></p></article><div class="sidebar"><a href=1>Archive</a></div>
-++++- <nav><a href=1>Home</a></nav><div id=main class="col sidebar-left"><h1>Fog</h1><p>It came in from the sea at noon, and by the evening no one could see the other side of the street.</p><p>Later it rose, and the moon stood over the roofs of the town as if nothing had been there at all.</p><p>Good.</p></div><div class="share"><a href=1>Share</a></div>
++++- <main class="search-results"><h3><a href=1>On dams</a></h3><p>A dam holds back what the river brings in spring, and lets it go when the fields below are dry.</p><h3><a href=1>Mud</a></h3><p>What stays behind is mud, and it has to be dug out every few years at no small cost.</p><div class="ad"><a href=1>Spades</a></div></main>
+++++-- <div class="page sidebar-right"><article class="legal"><h1>The new law</h1><p>Whoever owns a well has to report it to the county by the end of the year, the law now says.</p><p>Sources:</p><ul><li><a href=1>Text of the law</a></li><li><a href=1>Debate</a></li></ul></article><div class="comments"><article class="comment"><p>I have owned a well for years and nobody has ever asked me about it, so why should they now?</p></article></div></div><footer>{12}</footer>
+++- <div><h1>{4}</h1><p>{60}</p><p>{12}</p></div><footer>{30}</footer>
-+++-- <nav>{20}</nav><div><p>{45}</p><p>{3}</p><p>{80}</p></div><div class="ad">{40}</div><div class="comments">{50}</div>
++++ <p>{120}</p><p>{35}</p><p>{8}</p><p>{26}</p>
-++- <header>{12}</header><div>{50}</div><div>{30}</div><aside>{60}</aside>
++-- <div>{90}</div><div>{28}</div><form>{9}</form><footer>{70}</footer>
-++-- <div class="menu">{24}</div><p>{22}</p><p>{33}</p><div class="related">{18}</div><div class="sidebar">{140}</div>
-- <form>Your name please and your address</form><aside><p>Most read this week</p></aside>
--- <div>Menu</div><ul><li><a href=1>All</a></li><li><a href=1>Sports</a></li></ul>
--- <div class="menu">Food</div><div class="sidebar">A long text in a side bar is still not what a reader came for, whatever it may say in its many words.</div><footer>Made by hand in a small town by the sea, with care, for all of you who read this every day.</footer>
"""


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1 content) of the labelled blocks."""
    rows = [line.split(" ", 1) for line in re.sub(r"\{(\d+)\}", lambda m: "word " * int(m[1]), LABELLED).strip().splitlines()]
    return np.vstack([features(blocks(page)) for _, page in rows]), np.array([int(s == "+") for signs, _ in rows for s in signs])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
    """A decision tree by Gini impurity: (feature, cut, left, right), or a leaf's share of content."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (2.0 * share * (1 - share) * len(y) - 1e-9, None, None)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= cut
            n, p = left.sum(), y[left].mean()
            q = y[~left].mean()
            if least <= n <= len(y) - least and (cost := 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)) < best[0] - 1e-12:
                best = (cost, j, cut)
    if best[1] is None:
        return share
    left = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    """Whether each row is content."""
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    j, cut, left, right = tree
    out, low = np.zeros(len(x), bool), x[:, j] <= cut
    out[low], out[~low] = decide(left, x[low]), decide(right, x[~low])
    return out


@lru_cache(1)
def tree():
    """The tree of the labelled table; grown once a process, in milliseconds."""
    return grow(*labelled_table())


def main_text(page: str | None) -> str:
    """The content blocks of one page, one a line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = decide(tree(), features(found))
    return "\n".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with ``text`` (the main text) and ``n_chars`` (its code points); columns so named are replaced. No shuffle."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)
        give_back()

    out = without(pages, "text", "n_chars") if html.lower() not in ("text", "n_chars") else pages
    return out.withColumn("text", run(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
