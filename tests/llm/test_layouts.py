"""Main text of pages in handwritten layouts, each against the text a reader would copy."""

import time

import pytest

from eventlens.llm import html

A = "The river rose in the night, and by morning the lower fields, the lane and the old mill stood in water."
B = "People carried what they could to the school, where tea, bread and blankets had been laid out for them."
C = "By noon the rain had stopped, the wind had turned, and the first carts came back over the bridge."
TEXT = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = f"{A}\n{B}\n{C}"
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>"

LAYOUTS = {
    "flat body": (f"<body><h1>Flood</h1>{TEXT}</body>", f"Flood\n{WANT}"),
    "bare site name and copyright": (
        f"<body><div>Site name</div><h1>Flood</h1>{TEXT}<div>&copy; 2024 The Paper. All rights reserved.</div></body>", f"Flood\n{WANT}"),
    "menu of links without a class": (f"<body>{MENU}<h1>Flood</h1>{TEXT}{MENU}</body>", f"Flood\n{WANT}"),
    "link between paragraphs": (f"<body><p>{A}</p><p><a href=/m>The map of the valley</a></p><p>{B}</p></body>", f"{A}\nThe map of the valley\n{B}"),
    "list at the end": (f"<body><div>{TEXT}</div><ul><li>oats<li>rye</ul></body>", f"{WANT}\noats\nrye"),
    "classes copyright, legal and teasers": (
        f"<body><div class=wide>{TEXT}</div><div class=copyright>2024 by us, the makers.</div><div class=legal>Terms hold for all readers.</div>"
        f"<div class=teasers><h3>Other</h3><p>{B}</p></div></body>", WANT),
    "headings with ids of their text": (
        f"<main><h2 id=related-work>Related work</h2><p>{A}</p><h3 id=share-prices>Share prices</h3><p>{B}</p></main>",
        f"Related work\n{A}\nShare prices\n{B}"),
    "sections named by topic": (
        f"<main><section id=search><p>{A}</p></section><div class=social-policy><p>{B}</p></div></main>", f"{A}\n{B}"),
    "layout names inside an article": (
        f"<article>{TEXT}<div class='social-share'>Share this</div><div class='related-posts'><p>{B}</p></div><div class=ad-slot-3>Buy, now.</div>"
        "<section id=comments><p>First!</p></section></article>", WANT),
    "content div": (f"<body><div class=top>The Paper</div><div id=content>{TEXT}<div class=share>Share</div></div></body>", WANT),
    "two columns": (f"<body><div class=row><div class=col-8>{TEXT}</div><div class='col-4 sidebar'><p>{B}</p></div></div></body>", WANT),
    "split text": (f"<body><div><p>{A}</p><p>{B}</p></div><div><h2>Later</h2><p>{C}</p></div></body>", f"{A}\n{B}\nLater\n{C}"),
    "form around the page": (
        f"<body><form action=/><div><h1>Flood</h1>{TEXT}</div><form class=find><label>Find</label><input></form></form></body>", f"Flood\n{WANT}"),
    "form inside the text": (f"<article>{TEXT}<form><h3>Write to us</h3><p>Your name, please.</p></form></article>", WANT),
    "byline between heading and text": (
        f"<body><h1>Flood</h1><div>by A. Writer</div><div>{TEXT}</div></body>", f"Flood\nby A. Writer\n{WANT}"),
    "two articles": (f"<body><article><p>{A}</p></article><article><p>{B}</p></article></body>", f"{A}\n{B}"),
    "outside main": (f"<body><p>{C}</p><main><p>{A}</p></main></body>", A),
    "only short bare text": ("<body><div>Hello</div></body>", "Hello"),
    "only a form": ("<form><p>Your name</p></form>", ""),
    "a greater-than sign in a quote": (f"<p title='a > b'>{A}</p>", A),
    "a quote without end": (f'<p title="a>{A}</p><p>{B}</p>', f"{A}\n{B}"),
    "table": (f"<body><div>{TEXT}</div><table><tr><td>Oats<td>12</table></body>", f"{WANT}\nOats\n12"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, want = LAYOUTS[name]
    assert html.extract(page) == want


@pytest.mark.parametrize("page", [
    "<b>" * 500 + "<p>some text, here" * 20_000, '<a title="x>' + "<b>t</b>" * 20_000, "<a " * 40_000, '<a b="' * 40_000 + ">",
    "<div>a" * 40_000, "<" * 200_000, "<form><p>a" * 20_000, "</b>" * 100_000,
])
def test_odd_pages_in_linear_time(page):
    start = time.monotonic()
    html.extract(page)
    assert time.monotonic() - start < 10
