"""Wrappers with names of noise keep the page's article; what is noise stays out."""

import pytest

from cohortloom.llm import page_text


def text(body):
    return page_text.main_text(page_text.parse(f"<html><body>{body}</body></html>"), set())


LONG = "The article goes on for a while and has more to say than all that is around it."
ARTICLE = f"<article><h1>Head</h1><p>{LONG}</p></article>"
ASIDE = '<div class="sidebar">links</div><div id="comments"><article class="comment-body">me too</article></div>'


@pytest.mark.parametrize("open_, close", [
    ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="has-sidebar">', "</div>"), ('<body class="x"><div id="no-sidebar">', "</div>"),
    ('<form action="/">', "</form>"), ('<div class="entry has-comments">', "</div>"), ('<div role="form">', "</div>"),
    ('<main><p>Crumb</p><div class="content-sidebar-wrap">', "</div></main>"),
])
def test_wrappers_keep_the_article(open_, close):
    assert text(f"{open_}{ARTICLE}{ASIDE}{close}").removeprefix("Crumb ") == f"Head {LONG}"
    assert text(f"{open_}<p>{LONG}</p>{ASIDE}{close}").removeprefix("Crumb ") == LONG
    assert text(f"{open_}<main><p>{LONG}</p></main>{ASIDE}{close}").removeprefix("Crumb ") == LONG


def test_noise_stays_out():
    thread = '<div id="comments">' + f"<article class='comment'><p>{LONG}</p></article>" * 5 + "</div>"
    assert text(f"<div><p>Short text.</p></div>{thread}") == "Short text."
    assert text(f"{ARTICLE}<div class='sidebar'><article>{LONG} {LONG}</article></div>{thread}") == f"Head {LONG}"
    assert text(f"<p>{LONG}</p><form>name</form><div class='newsletter'>join</div><nav><main>menu</main></nav>") == LONG
    assert text(f"<div style='display:none' class='has-sidebar'>{ARTICLE}</div><p>seen</p>") == "seen"
    assert text(f"<div class='sidebar'><article>Teaser</article></div><div><p>{LONG}</p></div>") == LONG
