"""Main text against pages of which it is known, on tables with the odd cases, and in linear time."""

import random
import time

import pytest

from tidemark.llm import html_text

SAID = "This is a paragraph of the article, with some words in it; it goes on. And it has a second sentence, too."
ART = f"<p>{SAID}<p>{SAID}"
#: Pages that hold SAID so often, and what else.
PAGES = {
    f'<div style="overflow:hidden">{ART}</div>': f"{SAID} {SAID}",
    f"<div title='the hidden id' data-class='ad'>{ART}</div>": f"{SAID} {SAID}",
    f"<form id=frame><div>{ART}</div><input><select><option>x</select><button>go</button></form>": f"{SAID} {SAID}",
    f"<article>{ART}<form>no</form></article>": f"{SAID} {SAID}",
    f'<article>{ART}<section class="related-work"><p>{SAID}</section></article>': f"{SAID} {SAID} {SAID}",
    f"<div class=c>{ART}</div><ul id=feedback><li>Nice, really nice, very nice, I say.<li>Yes, me too, as I said.</ul>": f"{SAID} {SAID}",
    f"<div class=c>{ART}</div><div class=thread><div><b>Ann</b> Nice, really nice, very nice, I say.</div></div>": f"{SAID} {SAID}",
    f"<div class=c>{ART}</div><div class=zz><div><time>1 May</time> Nice, very nice, I say, a good one. Good.</div><div><cite>Bo</cite> Other, and long, and long, I say. Bad.</div></div>": f"{SAID} {SAID}",
    f"<article>{ART}<article><p>Nice, long, comment, indeed.</article></article>": f"{SAID} {SAID}",
    f"<article>{ART}</article><section><h2>More</h2><p>{SAID}</section>": f"{SAID} {SAID} More {SAID}",
    f"<table><tr><td class=menu><a href=x>a</a><td>{ART}<td>x</table>": f"{SAID} {SAID}",
    f"<div>{ART}<ul><li>one<li>two</ul><p>{SAID}</div>": f"{SAID} {SAID} one two {SAID}",
    f"<main><h1>Top</h1>{ART}<p>Short</main><div>Site map</div>": f"Top {SAID} {SAID} Short",
    "<!doctype html><head><title>T</title></head><header>Site</header><nav><a>m</a></nav><div id=cookie-notice>We use, it.</div><article><h1>Head</h1><p>One &amp; two,\n  three.<br>Four <b>bo</b>ld.<p>Five.</p><script>var t='</p>';</script></article><div class='comments'><p>Nice, very long.</p></div><footer>f": "Head One & two, three. Four bold. Five.",
    "plain": "plain", "": "", "<nav>a</nav>": "", "<!-- a": "", "<p hidden>x</p>": "", "a<b": "a",
}


def made(draw, i):
    """A page of known main text in one of several frames."""
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    said = [f"{words(draw.randrange(12, 60))}, {words(6)}. {words(8)}." for _ in range(draw.randrange(3, 12))]
    title, items = words(5), [words(3) for _ in range(3)]
    body = f"<h1>{title}</h1><p>{said[0]}</p><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" + "".join(f"<p>{x}" for x in said[1:])
    nav = "".join(f"<li><a href='/{j}'>{words(2)}</a>" for j in range(6))
    frame = (
        f"<nav><ul>{nav}</ul></nav><article>{body}</article><aside><p>{words(20)}.</aside><footer>{words(9)}.</footer>",
        f"<div class=top-menu><ul>{nav}</ul></div><div class=text>{body}</div><div class='sidebar'>{words(30)}, {words(3)}.</div>",
        f"<ul>{nav}</ul><div id=main>{body}</div><form><label>{words(2)}</label><p>{words(10)}.</form><div class='comment-list'><div class=comment><p>{words(30)}.</div></div>",
        f"<body><form id=f><div>{body}</div><div role=banner>{words(12)}</div></form></body>",
    )[i % 4]
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head>{frame}", " ".join([title, said[0], *items, *said[1:]])


def test_pages():
    for page, text in PAGES.items():
        assert html_text.extract(page) == text, page
    assert html_text.extract(None) == ""


def test_made_pages():
    draw = random.Random(8)
    for i in range(200):
        page, text = made(draw, i)
        assert html_text.extract(page) == text, page


def test_tables(spark):
    draw = random.Random(9)
    page, text = made(draw, 0)
    long = "<article>" + f"<p>{SAID}</p>" * 20_000
    rows = [(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, None), (None, "v", "", "x"), (3, "w", long, "x"), (4, "x", "a퟿é<b>\U0001f600</b>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", " ".join([SAID] * 20_000), 20_000 * (len(SAID) + 1) - 1), (4, "x", "a퟿é\U0001f600", 4)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert html_text.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<a x" * 250_000, "<div>" * 100_000, "<div>" * 50_000 + "</x>" * 50_000, "<b>" * 50_000 + "<p>" * 50_000, "<p><table><tr><td>" + "<b>" * 30_000 + "<div></div>" * 30_000, '<a b="c' * 100_000, "<" * 1_000_000, "<!-- a " * 100_000, "<script>" * 100_000, "<td>" * 100_000], ids=range(10))
def test_linear_time(page):
    began = time.time()
    html_text.extract(page)
    assert time.time() - began < 10
