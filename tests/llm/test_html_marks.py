"""Loose words in attributes do not hide an article's text."""

import pytest
from trackloom.llm import html_text

TEXT = "plain words of an article that go on for quite a while and say something " * 4


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="The hidden truth"', 'data-x="/hidden/gem"'])
@pytest.mark.parametrize("tag", ["body", "div", "article"])
def test_hidden_as_a_word_of_a_value(tag, attrs):
    page = f"<html><nav>menu</nav><{tag} {attrs}><p>{TEXT}</p></{tag}></html>"
    assert html_text.Page(page).main_text(html_text.trained()) == TEXT.strip()


def test_hidden_parts_stay_out():
    for attrs in ("hidden", 'style="color:red; display: none"', "aria-hidden='true'", 'class="site-footer"', 'id="sidebar"'):
        page = f"<body><article><p>{TEXT}</p><div {attrs}>never seen</div></article></body>"
        assert html_text.Page(page).main_text(html_text.trained()) == TEXT.strip(), attrs


def test_names_of_content_are_kept():
    page = f'<body><article><div class="article-header"><h1>Title</h1></div><p>{TEXT}</p><h2 id="related-work">Related</h2><section id="search-methods"><p>{TEXT}</p></section><p class="notice-period">Notice <a href="/hidden/gem">a gem</a></p></article></body>'
    got = html_text.Page(page).main_text(html_text.trained())
    assert got.split("\n") == ["Title", TEXT.strip(), "Related", TEXT.strip(), "Notice a gem"]
