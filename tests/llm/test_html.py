"""Main text of pages by hand-made and generated pages."""

import html as h
import random
import time

import pytest

from loomspan.llm import htmltext


def page(rnd):
    """A page and its article's blocks."""
    def words(n):
        return " ".join("".join(rnd.choices("abcdeé&<", k=rnd.randrange(1, 8))) for _ in range(n))

    blocks = [words(rnd.choice([1, 2, 9, 40])) for _ in range(rnd.randrange(1, 9))]
    body = "".join(f"<{t}>{h.escape(b).replace(' ', rnd.choice([' ', '  ', chr(10)]), 1)}</{t}>" for b in blocks for t in [rnd.choice(["p", "h2", "li", "blockquote"])])
    style = rnd.randrange(3)
    article = {0: f"<article>{body}</article>", 1: f"<main><div>{body}</div></main>", 2: f'<div class="post-content">{body}</div>'}[style]
    noise = ['<nav><ul><li><a href="/x">Home</a></li></ul></nav>', "<script>var a='<p>no</p>';</script>", '<div class="ad">Buy these many good things now.</div>', "<aside><p>Something long that stands at the side of it all</p></aside>", '<form><label>Mail</label><input></form>', '<div id="cookie-notice">We bake.</div>', "<!-- <p>hidden</p> -->", "<style>p{}</style>"]
    rnd.shuffle(noise)
    after = ['<section class="comments"><p>I read all of this and have much to say about it.</p></section>', "<footer>&copy; me</footer>"]
    return f"<!DOCTYPE html><html><head><title>t</title></head><body><header><h1>Site</h1></header>{''.join(noise[:4])}{article}{''.join(noise[4:])}{''.join(after)}</body></html>", "\n\n".join(" ".join(b.split()) for b in blocks)


def test_generated_pages():
    rnd = random.Random(9)
    for _ in range(200):
        source, text = page(rnd)
        assert htmltext.main_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("<p>x", ""), ("<article><p>x <b", "x"), ("<article>a<br>b&nbsp;&amp;&#233;<p><b>c<p>d</article>", "a b &é\n\nc\n\nd"),
        ("<article><p>in</p><div class='related'><p>out of it</p></div><script>x</article>", "in"), ("<article><p title='a > b'>t</p></article>", "t"), ("<article><p>1 < 2</p></article>", "1 < 2"),
        ("<ul><li><a>Home</a><li><a>Shop</a></ul><h1>Head</h1><p>" + "long " * 30 + "</p><p>Short.</p><p>" + "text " * 20 + "</p><p><a>About</a> <a>Us</a></p>", "Head\n\n" + ("long " * 30).strip() + "\n\nShort.\n\n" + ("text " * 20).strip()),
    ],
)
def test_cases(source, text):
    assert htmltext.main_text(source) == text


def test_tree_learns_its_table():
    rows = htmltext.table()
    right = sum(htmltext.classify(tuple(r[:-1])) == bool(r[-1]) for r in rows)
    assert right / len(rows) > 0.99


def test_query(spark, make):
    from loomspan.llm import shared

    shared.importable(spark)
    df = spark.createDataFrame([(1, "u", "<article>ä</article>", "x"), (1, "u", "<article>ä</article>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in htmltext.extract_text(df).collect()), key=str)
    assert got == [(1, "u", "ä", 1), (1, "u", "ä", 1), (None, None, "", 0)]
    assert htmltext.extract_text(df.limit(0)).collect() == []


LONG, MORE = ("long " * 60).strip(), ("more " * 45).strip()


@pytest.mark.parametrize(
    ("source", "text"),
    [
        # a teaser's mark doesn't hide the text of the page
        (f"<article><p>Read this too</p></article><div><h1>Head</h1><p>{LONG}</p><p>{MORE}</p></div>", f"Head\n\n{LONG}\n\n{MORE}"),
        # long text outside the marked article, and a short line there
        (f"<article><p>{LONG}</p><p>end</p></article><div><p>{MORE}</p><p>short</p></div>", f"{LONG}\n\nend\n\n{MORE}"),
        # names of the layout
        (f"<div class='content right-sidebar'><p>{LONG}</p><p>end</p></div>", f"{LONG}\n\nend"), (f"<div class='page has-sidebar'><p>{LONG}</p><p>end</p></div>", f"{LONG}\n\nend"),
        (f"<div class='sidebar'><p>{LONG}</p><p>short</p></div>", LONG), ("<article><p>in</p></article><div class='right-sidebar'><p>out of it</p></div>", "in"),
        # links decide inside the article too
        (f"<article><p>{LONG}</p><ul><li><a>One</a><li><a>Two more</a><li><a>Three</a></ul><p>{MORE}</p></article>", f"{LONG}\n\n{MORE}"),
        # other texts than the article's
        (f"<article><p>{LONG}</p></article><div class='comments'><p>{MORE}</p></div>", LONG),
    ],
)
def test_marks_are_a_hint(source, text):
    assert htmltext.main_text(source) == text


def test_formulas_stay_in_their_sentence():
    assert htmltext.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> holds</p></article>") == "so x=2 holds"


@pytest.mark.parametrize("part", ["</span></section>", "<div>", "<div></section>", "<p>a", "<a '", "<!--", "<script>", "<li>b</ul>", "&amp;"])
def test_time_grows_with_the_page(part):
    def seconds(n):
        source = "<article>" + "<div>" * n + part * n + "x"
        return min(timed(source) for _ in range(3))

    def timed(source):
        began = time.process_time()
        htmltext.main_text(source)
        return time.process_time() - began

    assert seconds(16_000) < 10 * seconds(4_000) + 0.05


def test_long_page():
    text = " ".join(["word"] * 400_000)
    assert htmltext.main_text(f"<nav><a>Home</a></nav><article><p>{text}</p></article>") == text
