"""Main text where article and main elements, or names of classes, do not tell it by themselves."""

from __future__ import annotations

import pytest

from quire.llm.extraction import main_text

LONG = "A long sentence, with commas, and rather more of it here, goes on. Then comes another, and it ends."


@pytest.mark.parametrize("html, text", [
    (f"<main><h1>Title</h1><p>lead, {LONG}</p><article><p>body, {LONG}</p></article><p>more, {LONG}</p></main>",
     f"Title\nlead, {LONG}\nbody, {LONG}\nmore, {LONG}"),
    (f"<main><article><p>one, {LONG}</p></article><section><article><p>two, {LONG}</p></article></section></main>",
     f"one, {LONG}\ntwo, {LONG}"),
    (f"<body><div><h1>Title</h1><p>lead, {LONG}</p></div><article><p>body, {LONG}</p></article>",
     f"Title\nlead, {LONG}\nbody, {LONG}"),
    (f"<body><div><div>Log in</div></div><article><p>{LONG}</p><table><tr><td>7</td></tr></table><h5>h</h5></article>",
     f"{LONG}\n7\nh"),
    (f"<article><p>{LONG * 9}</p><p>{LONG * 9}</p><section><div>a</div><div>b</div><div>c</div></section></article>",
     f"{LONG * 9}\n{LONG * 9}"),
])
def test_paths_decide_on_every_page(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<div id=page class='no-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='content-with-sidebar'><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>other</div>", f"{LONG}\n{LONG}"),
    (f"<body class='comments-open has-sidebar'><div class='search-result-body'><article><p>{LONG}</p></article></div>"
     f"<div class=comments><p>{LONG * 3}</p></div>", LONG),
    (f"<article><h1>Title</h1><section class='notice-board'><p>{LONG}</p></section></article>", f"Title\n{LONG}"),
    (f"<main><section class='notice-board'><p>{LONG}</p></section></main>", LONG),
    (f"<article class=comment><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", f"{LONG}\nso x=1 holds"),
    (f"<article><p>{LONG}</p><object><p>{LONG}</p></object><div class='share'>tell</div></article>", f"{LONG}\n{LONG}"),
])
def test_names_hide_no_whole_article(html, text):
    assert main_text(html) == text
