"""HTML extraction: flat text blocks classified by a small decision tree.

A page is read once from left to right into flat blocks (runs of text between block-level tags). A block
has its word count and link density, those of the blocks before and after it, and where it stands: inside
or outside the page's article, inside a landmark that is no article text (navigation, footer, form, ...),
or below an element whose class, id or role says so. A decision tree, grown on the blocks of the small
labelled table ``LABELLED`` (pages whose blocks are marked ``+`` for article text or ``-``), keeps or drops
each block; kept blocks are joined in page order.

Everything is a narrow pass: no shuffle, memory for a batch of pages. Reading is linear in a page's length:
where tags never end, the places that a search has passed in vain are remembered, so each is passed once, and open
elements are found by their names, not by walking up.

Defined cases. Null or empty html, or none kept: empty text. Unclosed and stray tags are repaired as browsers
do in the common cases; a tag or comment cut off at the end of the page is dropped, an unclosed script hides
the rest. White space is any Unicode white space, also from references such as ``&nbsp;``; ``<br>`` is white
space. Null ids and repeated rows each give a row. Other columns are ignored. Pages are never cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import read

QUERY = "op5_html_text"

#: At a "<": the name of a tag; a comment, other markup, or a tag that is cut off.
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARKUP = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S)
_EVENT = re.compile(r"""[>=]""")
_VALUE = re.compile(r"""=\s*(["'])""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = set("script style noscript template svg textarea iframe object canvas audio video head title select datalist noframes noembed".split())
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_LANDMARKS = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "search", "fieldset"}
_FENCES = {"article", "body", "table"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An opening tag ends open elements of the second kind, if no element of the third kind lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class or id that say what is no article text: adverts and notices, reader comments, and parts of a page's frame.
_PAID = set("ad ads adv advert adverts advertisement advertising alert consent cookie cookies gdpr notice notification paywall popup promo promoted promotion sponsor sponsored warning".split())
_COMMENTS = {"comment", "comments", "reply", "replies", "disqus"}
_FRAME = set("banner breadcrumb breadcrumbs complementary contentinfo copyright dialog footer header login masthead menu modal nav navbar navigation newsletter pagination recommended related search share sharing sidebar signup skip social subscribe subscription teaser toolbar widget".split())
#: Words that take the frame's words back: such an element is a wrapper.
_GOOD = {"article", "content", "entry", "main", "post", "story", "body", "text"}
#: Roles of elements that are no article text.
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Elements of running text: their names mark them only if they say nothing else.
_RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "th", "dt", "dd", "figcaption", "tr", "ul", "ol", "dl", "table"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "landmark", "named", "heading")


def _named(attributes: str, running: bool) -> tuple[bool, bool]:
    """Whether attributes name something that is no article text, or reader comments."""
    words: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "role":
            hidden = hidden or value.strip().lower() in _ROLES
        elif name in ("class", "id"):
            words.update(w.lower() for w in _TOKEN.findall(value))
    words = {w for w in words if not w.isdigit()}
    if running:
        return hidden or bool(words) and words <= _PAID | _COMMENTS | _FRAME, bool(words) and words <= _COMMENTS
    return hidden or bool(words & (_PAID | _COMMENTS)) or bool(words & _FRAME) and not words & _GOOD, bool(words & _COMMENTS)


class _Tags:
    """Ends of a page's tags. A quote opens a value only after "="; a value that never ends opens none."""

    def __init__(self, page: str):
        self.page = page
        self.vain: set[int] = set()  # places that a search has passed without finding an end
        self.next = (0, -1)  # the event at or after the places of a range
        self.no_more = {'"': len(page), "'": len(page)}  # from here on the quote does not come

    def _event(self, at: int) -> int:
        low, found = self.next
        if not low <= at <= found:
            m = _EVENT.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.next = (at, found)
        return found

    def end(self, at: int) -> int:
        """Place of the ">" that ends a tag which is open at ``at``; -1: none."""
        page, passed = self.page, []
        while True:
            at = self._event(at)
            if at == len(page) or at in self.vain:
                self.vain.update(passed)
                return -1
            if page[at] == ">":
                return at
            passed.append(at)
            m = _VALUE.match(page, at)
            if not m:
                at += 1
                continue
            quote, first = m[1], m.end()
            close = page.find(quote, first) if first < self.no_more[quote] else -1
            if close < 0:
                self.no_more[quote] = min(self.no_more[quote], first)
            at = first if close < 0 else close + 1


class _Block:
    __slots__ = ("article", "heading", "landmark", "linked", "named", "text", "words")

    def __init__(self, text, linked, flags, heading):
        self.text, self.words, self.linked = text, len(text.split(" ")), linked
        self.article, self.landmark, self.named = flags
        self.heading = heading


def blocks(page: str | None) -> list[_Block]:
    """The flat text blocks of a page."""
    page = page or ""
    out: list[_Block] = []
    #: (tag, (in article, in landmark, named), hidden) of open elements
    stack: list[tuple[str, tuple[bool, bool, bool], bool]] = [("", (False, False, False), False)]
    texts: list[str] = []
    linked = [0, False]
    heading = False

    def flush():
        nonlocal heading
        joined = " ".join("".join(texts).split())
        if joined:
            out.append(_Block(joined, linked[0], stack[-1][1], heading))
        texts.clear()
        linked[0], heading = 0, False

    def take(raw: str):
        if raw and not stack[-1][2]:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if linked[1]:
                linked[0] += len(text.split())

    #: places in the stack: of each tag, of block-level elements, and of those that an inline end tag stays in
    places: dict[str, list[int]] = defaultdict(list)
    blocks_at: list[int] = []
    fences: list[int] = []

    def close(k: int):
        """End the element at stack position ``k`` and all inside it."""
        if blocks_at and blocks_at[-1] >= k:
            flush()
        for tag, _, _ in stack[k:]:
            places[tag].pop()
        for held in (blocks_at, fences):
            while held and held[-1] >= k:
                held.pop()
        del stack[k:]

    def last(tags) -> int:
        """Stack position of the innermost open element with one of the tags; 0: none."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    at = begin = 0
    tags = _Tags(page)
    while (begin := page.find("<", begin)) >= 0:
        letter = begin + 1 + page.startswith("/", begin + 1)
        named = page[letter : letter + 1].isascii() and page[letter : letter + 1].isalpha()
        end = tags.end(letter) if named else -1
        if end < 0:
            m = _MARKUP.match(page, begin)
            if m:
                take(page[at:begin])
                at = begin = m.end()
            else:
                begin += 1
            continue
        take(page[at:begin])
        m = _NAME.match(page, begin)
        tag, attributes = m[2].lower(), page[m.end() : end]
        at = begin = end + 1
        if m[1]:
            if tag == "a":
                linked[1] = False
            if tag == "p" and not places["p"] or tag == "br":
                texts.append(" ")
            if (k := last((tag,))) and (tag in _BLOCKS or not fences or fences[-1] <= k):
                close(k)
            continue
        if tag in _BLOCKS:
            if blocks_at and stack[blocks_at[-1]][0] == "p":
                close(blocks_at[-1])
            if tag in _ENDS:
                ends, limits = _ENDS[tag]
                if (k := last(ends)) > last(limits):
                    close(k)
            flush()
        if tag == "a":
            linked[1] = True
        if tag == "br":
            texts.append(" ")
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS and tag not in _RAW:
            continue
        article, landmark, named = stack[-1][1]
        if attributes and tag not in ("html", "body"):
            bad, comments = _named(attributes, tag in _RUNNING)
            named = named or (comments if tag in ("article", "main") else bad)
        landmark = landmark or tag in _LANDMARKS or tag == "header" and not article
        article = article or tag in ("article", "main")
        if tag in _HEADINGS:
            heading = True
        places[tag].append(len(stack))
        if tag in _BLOCKS:
            blocks_at.append(len(stack))
        if tag in _FENCES:
            fences.append(len(stack))
        stack.append((tag, (article, landmark, named), stack[-1][2] or tag in _HIDDEN))
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = begin = end.start() if end else len(page)
    take(page[at:])
    flush()
    return out


def features(found: list[_Block]) -> np.ndarray:
    """Rows of ``FEATURES``; place is 1 inside the page's article, -1 outside it, 0 if it has none."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)))
    if n:
        some = any(b.article for b in found)
        out[:, 0], out[:, 1] = words, links
        out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
        out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
        out[:, 6] = [0 if not some else 1 if b.article else -1 for b in found]
        for k, name in enumerate(("landmark", "named", "heading"), 7):
            out[:, k] = [getattr(b, name) for b in found]
    return out


_PROSE = "The river rose again on Tuesday, and the old bridge was closed while engineers looked at its northern pier."
_MORE = "Nobody was hurt, but the market on the far bank stood empty for most of the day."
#: The labelled table: pages whose blocks begin with + (article text) or - (anything else).
LABELLED = (
    f"<body><nav><ul><li><a>- Home</a><li><a>- World news</a><li><a>- Sport</a></ul></nav><div class=ad>- Buy two, get one free until Sunday</div><article><h1>+ Bridge closed</h1><p>+ {_PROSE}<p>+ {_MORE}<p>+ Yes.<p>+ {_PROSE}</article><footer>- &copy; 2020 The Paper and its partners, all rights reserved</footer>",
    f"<body><header><a>- The Paper</a><p>- News that you can use, every day of the week</header><main><h1>+ Floods</h1><p>+ {_MORE}</p><aside>- Read also <a>what the mayor said</a></aside><p>+ Short.</p><blockquote>+ We will rebuild it.</blockquote><div class=share><a>- Share</a> <a>this</a></div><p>+ See <a>the report</a> for more.</p></main><div id=sidebar><h3>- Most read</h3><p>- {_PROSE}</p></div><footer><p>- {_MORE}</p></footer>",
    f"<body><div id=menu><a>- Home</a></div><div><h1>+ A page without landmarks</h1><p>+ {_PROSE}</p><p>+ {_MORE} {_PROSE}</p></div><div><a>- About us</a> <a>Contact</a> <a>Terms</a></div>",
    f"<body><p><a>- Back to the overview</a></p><h2>+ Notes on the harbour</h2><p>+ {_PROSE} {_MORE}</p><p>+ {_MORE}</p><p>- <a>Next page</a></p><p>- <a>Imprint</a></p>",
    f"<body><article><h1>+ With comments</h1><p>+ {_PROSE}</p><ul><li>+ first point<li>+ second point, with <a>a link</a></ul><section class=comments><h2>- Comments</h2><p>- {_MORE}</p><article class=comment><p>- I saw it, too. {_PROSE}</p></article></section></article><form><label>- Your name</label><p>- {_MORE}</p></form>",
    f"<body><div class='cookie-notice'><p>- We use cookies to make this site better. {_MORE}</p></div><div class=content><p>+ {_PROSE}</p><p>+ {_PROSE} {_MORE}</p></div><div class='site-footer'>- {_MORE}</div>",
    f"<body><p>- {_MORE}</p><p>- Today</p><article><h1><a>+ A headline that is a link</a></h1><p>+ {_PROSE}</p><p><a>+ The whole report</a></p><p>+ {_MORE} {_PROSE}</p></article><p>- {_PROSE}</p><p>- {_MORE} {_PROSE}</p>",
    f"<body><article><h2>+ Cut off</h2><p>+ {_PROSE}</p><ul><li><a>+ First source</a><li><a>+ Second source</a></ul><p>+ {_MORE}",
    f"<body><div><a>- Start</a></div><p>+ {_PROSE}</p><p>+ {_MORE} {_PROSE}",
    f"<main><p>+ {_MORE}</p><p>+ Nothing else.</p></main><div>- Ask us, we are glad to help you</div>",
    f"<p>+ {_PROSE}</p><p>+ {_MORE}</p>",
    f"<article><h1>+ Ends short</h1><p>+ {_PROSE}</p><p>+ The end.</p></article>",
    f"<main><p>+ {_PROSE}</p><p>+ So it was.</p></main>",
    f"<article><p>+ {_MORE}</p><p>+ Cut of",
    f"<article><p>+ {_PROSE}</p></article>",
    f"<main>+ {_MORE}</main>",
    f"<body><p>+ {_PROSE}</p></body>",
    f"<article><h1>+ Again</h1><p>+ Yes.</p><p>+ {_MORE}</p></article>",
    "<article><p>+ One</p><p>+ Two</p></article>",
    "<article>+ Three words here</article>",
    f"<article><h1><a>+ A headline with a link</a></h1><p>+ Jane Doe</p><p>+ {_PROSE}</p><p>+ {_MORE}</p></article>",
    "<article><p><a>+ Source one here</a></p><p>+ Yes.</p><p><a>+ Source two</a> <a>and three</a></p></article>",
    f"<main><h1><a>+ Linked</a></h1><ul><li><a>+ One</a></li><li><a>+ Two</a></li></ul><p>+ No.</p><p><a>+ {_MORE}</a></p><h2>+ End</h2></main><p><a>- Next</a></p>",
    f"<article><p>+ By Jane Doe</p><p><a>+ Jane Doe</a></p><h2>+ Why</h2><p>+ {_PROSE}</p><p><a>+ Read the law</a></p></article><p><a>- Read on</a></p><p>- Jane Doe</p>",
    f"<body><div><a>- Home</a></div><div>- Edition of Monday morning</div><div><a>- Sport</a></div><h1>+ Ferry sinks at pier</h1><p>+ {_PROSE}</p><p>+ Yes.</p><p>+ {_MORE}</p><div><a>- Next page</a></div><div>- All rights reserved here</div>",
    f"<body><p>- Today</p><div><a>- World</a> <a>Local</a></div><h2>+ The pier</h2><p>+ {_PROSE}</p><h2>+ The bank</h2><p>+ {_MORE}</p><p>+ So ends the tale.</p><div><a>- About</a> <a>Help</a></div><p>- Printed in Harbour Street</p>",
    f"<h2>- Elsewhere</h2><article><h2>+ Here</h2><p>+ {_PROSE}</p></article><h3>- Yesterday</h3><p>- {_PROSE}</p><h3>- More stories</h3>",
    f"<article><p>+ {_PROSE}</p><aside><p>- {_MORE}</p><p>- {_PROSE}</p></aside><p>+ {_MORE}</p><form><p>- {_MORE}</p></form><footer><p>- {_PROSE}</p></footer></article>",
    f"<main><nav>- {_MORE}</nav><p>+ {_PROSE}</p><form>- {_PROSE}</form><p>+ {_MORE}</p><aside>- Brief</aside><p>+ Brief.</p><aside>- {_PROSE} {_MORE}</aside></main>",
    f"<body><nav><p>- {_PROSE}</p></nav><p>+ {_MORE}</p><form><p>- {_PROSE}</p></form><p>+ {_PROSE}</p><aside>- {_MORE}</aside>",
    f"<body><div><a>- Login</a></div><div><a>- Shop</a> | <a>Help</a></div><p>+ {_MORE} {_PROSE}</p><p>+ {_PROSE}</p><div><a>- More</a></div><div>- Copyright 2020</div>",
)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    x, y = [], []
    for page in LABELLED:
        found = blocks(page)
        for b in found:
            y.append(b.text[0] == "+")
            b.words, b.linked = b.words - 1, min(b.linked, b.words - 1)
        x.append(features(found))
    return np.concatenate(x), np.array(y, bool)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: (feature, threshold, below, above), or a leaf's verdict.

    Ties go to what says where a block stands, then to the first feature, so the tree is always the same.
    """
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = None
    for f in (7, 8, 6, 1, 0, 3, 5, 2, 4, 9):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < t
            cost = sum(s.sum() * (~s).sum() / len(s) for s in (y[below], y[~below]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), below)
    if best is None:
        return bool(2 * y.sum() > len(y))
    _, f, t, below = best
    return f, t, grow(x[below], y[below], depth - 1), grow(x[~below], y[~below], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    """The tree's verdict on each row."""
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, t, below, above = tree
    low = x[:, f] < t
    return np.where(low, classify(below, x), classify(above, x))


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    keep = classify(tree, features(found))
    return "\n\n".join([b.text for b, k in zip(found, keep, strict=True) if k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = grow(*labelled_blocks())

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
