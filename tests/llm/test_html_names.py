"""Names and forms speak against text, but do not rule it out."""

from __future__ import annotations

import pytest

from gridsla.llm import html

PROSE = "The river runs under seven old bridges and nobody counts them any more. It is late in the year."
BODY = f"<h1>Bridges of stone</h1><p>{PROSE}</p><p>Second: {PROSE}</p><p>Third: {PROSE}</p>"
WANT = ["Bridges of stone", PROSE, f"Second: {PROSE}", f"Third: {PROSE}"]
NAV = "<nav><a href=/a>Home</a></nav>"


@pytest.mark.parametrize("name", ["has-sidebar", "overflow-hidden", "elementor-widget-container", "no-comments", "content-with-menu", "form"])
@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", BODY, f"<main>{BODY}</main>", f"<div class=post>{BODY}</div>"])
def test_wrapper_names_keep_the_article(name, inner):
    page = f"<body>{NAV}<div class='{name}'>{inner}<div class='ad'>Buy this now, it is cheap.</div></div><footer>site</footer></body>"
    assert html.extract(page).split("\n") == WANT


@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", BODY])
def test_a_form_round_the_page(inner):
    page = f"<body><form action=/x><div id=aspnet>{NAV}{inner}<fieldset><p>Sign up</p></fieldset></div></form></body>"
    got = html.extract(page)
    assert got == html.extract(page.replace("form", "div")) and all(p in got.split("\n") for p in WANT[1:])


def test_every_paragraph_in_a_named_container():
    parts = "".join(f"<div class='elementor-widget-container'><p>{i} {PROSE}</p></div>" for i in range(5))
    assert html.extract(f"<body>{NAV}<main>{parts}</main></body>").count("\n") == 4


def test_the_title_in_the_header_of_an_article():
    page = f"<body><header><h2>My site</h2></header><article><header><h1>Title here</h1></header><p>{PROSE}</p></article></body>"
    assert html.extract(page) == f"Title here\n{PROSE}"


def test_comments_and_teasers_still_go():
    comments = "".join(f"<li><article class=comment-body><p>{i}: I do not agree with this at all, sorry.</p></article>" for i in range(6))
    teasers = "".join(f"<article><h3><a href=/{i}>Another story to read</a></h3></article>" for i in range(3))
    page = (f"<body><div class=has-sidebar><article>{BODY}</article><div class=comments><ol>{comments}</ol></div>"
            f"<div class=related>{teasers}</div></div><form><p>Sign up</p></form></body>")
    assert html.extract(page).split("\n") == WANT
