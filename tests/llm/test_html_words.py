"""Words in class and id take no article text out; density decides."""

import pytest

from sitelens.llm import html_text

LONG = ("a " * 60).strip()


@pytest.mark.parametrize("page, text", [
    (f"<article><p>{LONG}</p><h2 id='related-work'>Related work</h2><section id='social-impact'><p>{LONG}</p></section></article>", f"{LONG}\n\nRelated work\n\n{LONG}"),
    (f"<article><p class='notice-text'>{LONG}</p><div class='overflow-hidden'><p>{LONG}</p></div><div style='overflow:hidden'><p>x {LONG}</p></div></article>", f"{LONG}\n\n{LONG}\n\nx {LONG}"),
    (f"<body><div class='content with-sidebar'><p>{LONG}</p><p>b c</p></div></body>", f"{LONG}\n\nb c"),
    (f"<article><p>{LONG}</p><p hidden>h</p><p style='color:red; display: none'>h</p><p aria-hidden=true>h</p><div class='share-links'><a href=x>one</a> <a href=y>two</a></div></article>", LONG),
    (f"<article><div class=widget><p>{LONG}</p></div><p>x <span class=notice>kept</span> y</p></article>", f"{LONG}\n\nx kept y"),
    (f"<article><p>{LONG}</p><p>See the <span class=comments>remarks</span> of <b class='ad'>Adams</b> and <em id=cookies>cookies</em>.</p></article>", f"{LONG}\n\nSee the remarks of Adams and cookies."),
    (f"<article><p>{LONG}</p><div class=cookies><h2>Baking</h2><p>Mix the butter {LONG}</p><p>Then bake {LONG}</p></div></article>", f"{LONG}\n\nBaking\n\nMix the butter {LONG}\n\nThen bake {LONG}"),
    (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> holds.</p></article>", f"{LONG}\n\nSo x=y2 holds."),
    (f"<body><div class=cookies><p>We use cookies. <a href=x>More</a> <a href=y>Fine</a></p></div><article><p>{LONG}</p><div class=cookie-notice>We use cookies.</div><p>x <span hidden>no</span><i style='display:none'>no</i> y</p></article></body>", f"{LONG}\n\nx y"),
])
def test_article_text_stays(page, text):
    assert html_text.extract(page) == text
