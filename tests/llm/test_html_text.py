"""HTML extraction on small pages, on generated pages whose article is known, and tags against a plain pattern."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import html_text as h

TREE = h.grow(*h.labelled_blocks())
BODY = "The council met again on Friday to talk about the harbour, the bridge and the new school by the river."


def text(page):
    return h.main_text(page, TREE)


def test_tree_fits_its_table():
    x, y = h.labelled_blocks()
    assert (h.classify(TREE, x) == y).all()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<html><head><title>T</title></head><body></body>", ""),
        (f"<nav><a>Home</a></nav><article><h1>A &amp; B&nbsp;C</h1><p>{BODY}<p>Ok.<br>Fine.</article><footer>F</footer>", f"A & B C\n\n{BODY}\n\nOk. Fine."),
        (f"<article><p>{BODY}</p><script>var t='</p>';</script><p>a <b>bo</b>ld  word\n here</p><!-- <p>no</p> --></article>", f"{BODY}\n\na bold word here"),
        (f"<article><p>{BODY}</p><div class='comments'><p>{BODY}</p></div><form><p>{BODY}</p></form><aside>{BODY}</aside></article>", BODY),
        (f"<header><p>{BODY}</p></header><article><p>{BODY}</p><p>cut off in the mid", f"{BODY}\n\ncut off in the mid"),
        (f"<article><p>{BODY}</p><p>cut in a tag <a href='x", f"{BODY}\n\ncut in a tag"),
        (f"<article><p>1 < 2 & 3 > 2 &lt;p&gt; {BODY}</p></article>", f"1 < 2 & 3 > 2 <p> {BODY}"),
        (f"<div class='cookie-banner'>{BODY}</div><main><p>{BODY}</p><p hidden>no</p></main><div role=navigation>{BODY}</div>", BODY),
        (f"<body class='has-sidebar ads'><main class='content-sidebar'><p>{BODY}</p></main></body>", BODY),
        (f"<ARTICLE><P title='a>b'>{BODY}</P><P>x</P></ARTICLE></p></div>", f"{BODY}\n\nx"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_neighbours_decide():
    """Without landmarks, the tree asks what stands around a block."""

    def used(tree):
        return set() if isinstance(tree, bool) else {h.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert used(TREE) & {"words_before", "links_before", "words_after", "links_after"} and used(TREE) & {"words", "links"}
    page = f"<body><div><a>Home</a></div><div>Weather for the week</div><div><a>Sport</a></div><p>{BODY}</p><p>{BODY}</p>"
    assert text(page) == f"{BODY}\n\n{BODY}"


@pytest.mark.parametrize("page, want", [
    ("<article><h1><a>headline</a></h1><p>Jane Doe</p></article>", "headline\n\nJane Doe"),
    ("<article><p><a>Source one here</a></p><p>Yes.</p></article>", "Source one here\n\nYes."),
    ("<article><h2 id=header-news>News</h2><p class=story-comment-lead>Lead</p></article>", "News\n\nLead"),
    (f"<div role=alert>{BODY}</div><div class=warning>{BODY}</div><div class=sponsored-content>{BODY}</div><p>{BODY}</p><p>{BODY}</p>", f"{BODY}\n\n{BODY}"),
    ("<article><p>One <select><option>a<option>b</select> block</p></article>", "One block"),
])
def test_article_text_and_notices(page, want):
    assert text(page) == want


ASIDES = ["<nav><ul><li><a>Home</a><li><a>News</a></ul></nav>", "<footer><p>{0}</p></footer>", "<div class='cookie-banner'><p>{0}</p></div>", "<aside><h3>Most read</h3><p>{0}</p></aside>", "<form><label>{0}</label></form>", "<div class='sidebar'>{0}</div>", "<div role=status>{0}</div>", "<script>var a = '<p>{0}</p>';</script>", "<section id=comments><article class=comment><p>{0}</p></article></section>", "<div class=ad-box>{0}</div>", "<!-- <p>{0}</p> -->", "<p class=advertisement>{0}</p>"]


def test_no_article_text_is_lost():
    """Generated pages: all of the article, in order, and nothing else."""
    rnd = random.Random(11)
    for _ in range(400):
        want, inner = [], []
        for _ in range(rnd.randint(1, 12)):
            if rnd.random() < 0.25:
                inner.append(rnd.choice(ASIDES).format(BODY))
                continue
            words = [rnd.choice("the a river Bridge no. 7 über &amp; x&lt;y é".split()) for _ in range(rnd.choice([1, 1, 2, 5, 30]))]
            raw, plain = " ".join(words), " ".join(words).replace("&amp;", "&").replace("&lt;", "<")
            body = rnd.choice(["{}", "<a href='x>y'>{}</a>", "<b>{}</b>", "<em\n>{}</em >", "{}<br>", "<span>{}</span>"]).format(raw)
            name = rnd.choice(["", "", " class=header-line", " id='comment-on-law'", " class='share-price'", " id=search-results-text"])
            block = rnd.choice(["<p{0}>{1}</p>", "<p{0}>{1}", "<h1{0}>{1}</h1>", "<h3{0}>{1}</h3>", "<ul><li{0}>{1}</ul>", "<blockquote{0}>{1}</blockquote>", "<table><tr><td{0}>{1}</table>"])
            inner.append(block.format(name, body))
            want.append(plain)
        tag = rnd.choice(["article", "main"])
        page = "".join(rnd.choice(ASIDES).format(BODY) for _ in range(rnd.randint(0, 3))) + f"<{tag}>" + "".join(inner) + f"</{tag}>" + "".join(rnd.choice(ASIDES).format(BODY) for _ in range(rnd.randint(0, 3)))
        assert text(page) == "\n\n".join(want), page


@given(st.lists(st.sampled_from(["<", ">", "=", '"', "'", "a", "/", " ", "!", "b='", '="']), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_ends_of_tags(page):
    """As a pattern that tries every way of reading, from any place."""
    plain = re.compile(r"""(?>[^>"'=]+|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""", re.S)
    tags = h._Tags(page)
    for at in range(len(page)):
        m = plain.match(page, at)
        assert tags.end(at) == (m.end() - 1 if m else -1), (page, at)


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>{BODY} {k}</p>" for k in range(5000)) + "</article>"
    assert text(page) == "\n\n".join(f"{BODY} {k}" for k in range(5000))


def test_pathological_tags():
    """Each takes well under a second for hundreds of thousands of tags that never end."""
    for page in ("<" * 200_000, "<a " + "x='" * 100_000, "<!--" * 100_000, "<a x='1' " * 100_000, "<a x=\"<a x='" * 50_000, "<a" * 200_000):
        began = time.process_time()
        assert isinstance(text(page), str)
        assert time.process_time() - began < 20


def test_query(spark):
    rows = [(1, "u", f"<article><p>{BODY}</p></article>", "c"), (1, "u", None, "c"), (None, None, "", "c")]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted([("1", BODY, len(BODY)), ("1", "", 0), ("None", "", 0)])
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
