"""Pages whose elements and classes do not tell content from the rest: only the ratios can."""

import re

import pandas as pd
import pytest

from glyphmill.llm import html

STORY = [f"Part {i} of the story is told here at some length, with marks; it goes on, and on, as stories do." for i in range(5)]
PARTS = {
    "menu": "<div><ul><li><a href=/1>Home</a><li><a href=/2>News</a><li><a href=/3>About</a></ul></div>",
    "notice": "<div><p>We set small files, as all do.</p><p>Fine</p></div>",
    "remarks": "<div><h3>Remarks</h3><p>I do not think so, friend.</p><p>Me neither, to be honest.</p></div>",
    "footer": "<div><p>&copy; us, this year.</p><p><a href=/t>Terms</a></p></div>",
}
ARTICLE = "<div><h1>The story</h1>" + "".join(f"<p>{p}</p>" for p in STORY) + "<ul><li>one</li><li>two</li></ul></div>"
TEXT = "\n".join(["The story", *STORY, "one", "two"])


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
def test_each_kind_of_part_goes_without_a_name(part, wrap):
    for page in (PARTS[part] + ARTICLE, ARTICLE + PARTS[part]):
        assert html.main_text(f"<html><body>{wrap.format(page)}</body></html>") == TEXT


def test_all_parts_together_and_the_ratios_alone_leave_them_out(monkeypatch):
    page = "<body>" + PARTS["menu"] + PARTS["notice"] + ARTICLE + PARTS["remarks"] + PARTS["footer"] + "</body>"
    assert html.main_text(page) == TEXT
    monkeypatch.setattr(html, "MOST", 1.1)  # nothing holds so much: all of these stay
    assert all(x in html.main_text(page).split("\n") for x in ("Me neither, to be honest.", "© us, this year.", *STORY))


def test_headings_before_the_text_stay_and_those_behind_it_go():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    page = f"<body>{PARTS['menu']}<div><h1>The story</h1><h2>Of long ago</h2><div>{body}</div><h3>Remarks</h3><div><p>No.</p><p>Yes.</p></div></div></body>"
    assert html.main_text(page) == "\n".join(["The story", "Of long ago", *STORY])


@pytest.mark.parametrize("name", ["widget", "page-header banner", "social", "sidebar"])
def test_a_wrapper_with_a_misleading_class_stays(name):
    wrapped = ARTICLE.replace("<div>", f"<div class='{name}'>", 1)
    assert html.main_text(f"<body><p>Soon.</p>{wrapped}</body>").endswith("\n".join(STORY) + "\none\ntwo")
    # where other text stands against it, or an article element is there, it goes
    other = "".join(f"<p>{p}</p>" for p in STORY[:4])
    assert html.main_text(f"<body><div>{other}</div>{wrapped}</body>") == "\n".join(STORY[:4])
    assert html.main_text(f"<body><article><p>Short, but it is the article.</p></article>{wrapped}</body>") == "Short, but it is the article."


@pytest.mark.parametrize("name", ["comments", "ad", "cookie-notice", "menu", "footer", "newsletter"])
def test_other_class_names_are_never_content(name):
    assert html.main_text("<body>" + ARTICLE.replace("<div>", f"<div class='{name}'>", 1) + "</body>") == ""


def test_pages_of_the_table_without_any_name(data):
    """Sections become plain divs and classes go: a page whose article is a line or two cannot be told, others can."""
    pages = [p or "" for p in pd.read_parquet(f"{data}/pages.parquet").html]
    plain = [re.sub(r"(</?)(article|main|nav|header|footer|aside|section)\b[^>]*>", r"\1div>", re.sub(r'\s(class|id|role)="[^"]*"', "", p)) for p in pages]
    same = [html.main_text(a) == html.main_text(b) for a, b in zip(pages, plain, strict=True)]
    assert sum(same) >= 0.85 * len(pages)
    assert all(s for s, p in zip(same, pages, strict=True) if len(html.main_text(p)) > 400)


def test_deep_and_wide_pages_take_time_in_proportion():
    import time

    page = "<div>" * 20_000 + "<p>Text, at last.</p><p>And more.</p>" + "</div>" * 20_000 + "<div><p>x</p></div>" * 20_000
    began = time.perf_counter()
    assert "Text, at last." in html.main_text(page) and time.perf_counter() - began < 10
