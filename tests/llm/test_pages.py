"""Extraction on hand-made layouts, and parsing of odd pages."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from meterlake.llm import dom, extraction, sample_pages

A = "The river rose by two meters during the night, and the lower road was closed to all traffic."
B = "Engineers inspected the bridge in the morning; they found no damage, though debris had gathered at its piers."
C = "A second survey is planned for Friday, when the water should have fallen enough to reach the foundations."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'
LINKS = "".join(f'<li><a href="/{k}">Another story number {k}</a></li>' for k in range(6))

LAYOUTS = {
    "semantic": f"<html><body><header><nav>{MENU}</nav></header><main><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></article></main><footer><p>Copyright 2026. All rights reserved.</p></footer></body></html>",
    "classes": f'<html><body><div class="navbar">{MENU}</div><div id="content"><div class="post"><h2>Flood</h2><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div class="footer">Copyright 2026, contact us.</div></body></html>',
    "sidebar": f'<html><body><div class="wrap"><div class="sidebar"><h3>Related</h3><ul>{LINKS}</ul></div><div class="article-body"><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div></body></html>',
    "comments": f'<html><body><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><section id="comments"><h3>3 comments</h3><div class="comment"><p>I drove there yesterday. It was scary.</p></div><div class="comment"><p>Same here, stay safe everyone.</p></div></section></body></html>',
    "cookie": f'<html><body><div class="cookie-banner"><p>We use cookies. By going on you consent to them.</p><button>Accept</button></div><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></article></body></html>',
    "advert": f'<html><body><article><h1>Flood</h1><p>{A}</p><div class="ad sponsored"><a href="/buy">Buy boats now. Great prices, free delivery.</a></div><p>{B}</p><p>{C}</p></article></body></html>',
    "form": f'<html><body><form class="search"><label>Search this site</label><input name="q"></form><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><form class="newsletter subscribe"><p>Get our newsletter every week.</p><input></form></body></html>',
    "unclosed": f'<body><nav class="menu">{MENU.replace("</li>", "")}</nav><article><h1>Flood</h1><p>{A}<p>{B}<p title=it\'s>{C}</article><footer>Imprint',
    "hidden": f'<html><body><article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><div style="display:none" class="popup modal"><p>Subscribe to go on reading this page.</p></div><script>var x = "<p>no</p>";</script></body></html>',
    "table": f'<html><body><table class="layout"><tr><td class="nav menu">{MENU}</td><td class="content"><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table></body></html>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert extraction.main_text([LAYOUTS[name]], extraction.fit_elements()) == ["\n\n".join(["Flood", A, B, C])]


def texts(source):
    return [t for _, t in dom.parse(source).blocks]


def test_tags_that_are_odd():
    assert texts("<p title=it's>Hello there</p>") == ["Hello there"]
    assert texts('<p title="a>b">one</p><p title=\'"\'>two</p>') == ["one", "two"]
    assert texts("1 < 2 &amp; 3 <4 <b>bold</b> <!-- no --> yes <!doctype x><?php no ?> end") == ["1 < 2 & 3 <4 bold yes end"]
    assert texts('<p>kept <a href="never ends') == ["kept"]
    assert texts("<p>a<svg>b<p>c") == ["a b", "c"] and texts("<p>a<script>b<p>c") == ["a"]
    assert texts("</p></b></html>x</body>y") == ["xy"]


@pytest.mark.parametrize("unit", ["<a b ", "<b>", '<a "', "<a x='", "<svg>", "<!-- ", "< ", "</div>", "<i></b>", "<p " + "a" * 99, "&amp", "a"])
def test_time_is_in_proportion_to_the_length(unit):
    took = []
    for n in (1 << 17, 1 << 20):
        source = unit * (n // len(unit))
        began = time.process_time()
        dom.parse(source)
        took.append(time.process_time() - began)
    assert took[1] < max(1.5, 24 * took[0])


def test_deep_and_wide_pages():
    for unit in ("<ul>", "<ul><li><div>", "<p>", "<table><tr><td>", "<div><b></i>"):
        page = dom.parse(unit * 20_000 + "<p>deep words")
        assert page.blocks[-1][1] == "deep words" and len(dom.features(page)) == len(page.nodes)


def test_heads():
    assert texts('<head><script>document.write("</head>");alert(1)</script></head><body><p>Hi') == ["Hi"]
    assert texts("<head><title>T</title> <style>x</style><meta a=b></head><body><p>Hi") == ["Hi"]
    assert texts("<head><title>T</title><p>Hi</p>") == ["Hi"] and texts("<head>Hi</head>") == ["Hi"]
    assert texts("<html><head><link href=x><noscript><img></noscript></head>Hi") == ["Hi"]


def test_elements_within_their_like():
    assert texts("<p>a</p><template><template>x</template>leak</template><p>b") == ["a", "b"]
    assert texts("<p>a<object><object>x</object>y<object/></object>b") == ["a b"]
    assert texts("<p>a<svg><svg/>x</svg>b") == ["a b"]
    assert texts("<p>a</p><script>x</script foo><p>after</p>") == ["a", "after"]
    assert texts("<p>a</p><script><script>x</script><p>after</p><style>p</style\n><p>end") == ["a", "after", "end"]
    assert texts("<p>a<textarea><textarea>x</textarea>b") == ["a b"]


def test_end_tags_that_are_none_and_buttons():
    assert texts("<p>a </ x>b</>c</1 p>d</p>") == ["a bcd"]
    assert texts("<p><button>Share this</button>Engineers inspected") == ["Engineers inspected"]
    assert texts("<p>One <label>Your name <input></label>two</p>") == ["One two"]


def plain(count, before="<div><a href='/a'>Home</a> <a href='/b'>News</a></div>", after="<div>Imprint</div>", wrap="<div>{}</div>", names=""):
    body = "".join(f"<p>{t} Part {k}.</p>" for k in range(count) for t in [(A, B, C)[k % 3]])
    return f"<html><body>{before}{wrap.format(body)}{after}</body></html>", [f"{(A, B, C)[k % 3]} Part {k}." for k in range(count)]


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 6, 8, 12, 20, 60])
@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div class='inhalt'>{}</div>", "<div><div>{}</div></div>", "{}"])
def test_articles_of_divs_alone(count, wrap):
    """An article that is found stays found however long it is."""
    page, want = plain(count, wrap=wrap)
    assert extraction.main_text([page], extraction.fit_elements()) == ["\n\n".join(want)]


@pytest.mark.parametrize("count", [1, 3, 5, 8])
def test_headings_stay_with_paragraphs(count):
    page, want = plain(count, before="<h1>Flood</h1>", after="", wrap="{}")
    assert extraction.main_text([page], extraction.fit_elements()) == ["\n\n".join(["Flood", *want])]


def test_comments_after_an_article_of_divs():
    page, want = plain(4, after='<div id="comments"><h3>2 comments</h3><div class="comment"><p>I drove there yesterday. It was scary.</p></div><div class="comment"><p>Same here, stay safe.</p></div></div>')
    assert extraction.main_text([page], extraction.fit_elements()) == ["\n\n".join(want)]


def test_captions_of_the_article_are_text():
    page = f"<html><body><article><h1>Flood</h1><p>{A}</p><figure><img src=x><figcaption>The lower road on Monday.</figcaption></figure><p>{B}</p></article></body></html>"
    assert extraction.main_text([page], extraction.fit_elements()) == ["\n\n".join(["Flood", A, "The lower road on Monday.", B])]


def test_pages_without_prose_have_no_main_text():
    page = f'<html><body><div class="navbar">{MENU}</div><div class="footer">Imprint</div></body></html>'
    assert extraction.main_text([page, "", "<p></p>"], extraction.fit_elements()) == ["", "", ""]


class Visible(HTMLParser):
    """What the standard library's parser sees outside of elements without text of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def edge(self, tag):
        if tag in dom.BLOCK | dom.VOID | dom.RAW:
            self.parts.append(" ")

    def handle_starttag(self, tag, attrs):
        self.edge(tag)
        self.hidden += tag in dom.RAW

    def handle_endtag(self, tag):
        self.edge(tag)
        self.hidden -= tag in dom.RAW

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_visible_text_is_that_of_another_reader():
    for source in sample_pages.pages(40, 9):
        other = Visible()
        other.feed(source)
        assert " ".join(t for _, t in dom.parse(source).blocks).split() == "".join(other.parts).split()
