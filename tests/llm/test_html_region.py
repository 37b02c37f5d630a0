"""Main text on markup that the training pages do not hold, and word recall and precision on pages of another make."""

import random

import pytest
from trackloom.llm import html_text

TEXT = "plain words of an article that go on for quite a while and say something " * 4
BODY = f"<h1>The title</h1><p>{TEXT}</p><p>And an end.</p>"
WANT = f"The title\n{TEXT.strip()}\nAnd an end."


def text_of(page):
    return html_text.Page(page).main_text(html_text.trained())


@pytest.mark.parametrize("wrapper", ["page no-sidebar", "has-sidebar", "with-sidebar wrap", "main-widget", "widget", "page-header"])
def test_a_wrapper_of_the_whole_page_is_no_part(wrapper):
    assert text_of(f'<body><div class="{wrapper}"><nav>menu <a href="/">one</a></nav>{BODY}<footer>foot</footer></div></body>') == WANT


def test_headings_and_paragraphs_keep_their_names():
    page = f'<article><div class="post-header"><h1>The title</h1></div><p class="notice-of-meeting">A notice.</p><p>{TEXT}</p></article>'
    assert text_of(page) == f"The title\nA notice.\n{TEXT.strip()}"


def test_self_closed_drawings_end_there():
    assert text_of(f'<article><h1>The title</h1><svg class="i"/><p>{TEXT}</p><svg><path d="M0"/><text>never</text></svg><p>And an end.</p></article>') == WANT


@pytest.mark.parametrize("value", ["a<b and c>d", "x" * 9000 + "> more", "<p>no</p>", "it's > that"])
def test_quoted_values_hold_anything(value):
    assert text_of(f'<article>{BODY.replace("<p>And", f"""<p title="{value}" id=k>And""")}</article>') == WANT


def test_unclosed_quotes_are_linear_and_cost_their_tag_only():
    assert text_of(f"<article><a title=\"x>link</a> {BODY}</article>".replace('"', "'")).endswith("And an end.")
    for source in ('<a x="' * 50_000, "<a x='" * 50_000, '<a x="><b y=\'>' * 30_000, "<script>" * 50_000, "<!--" * 50_000, "=" * 100_000, "<a " + "=" * 100_000):
        html_text.Page(source).main_text(html_text.trained())


def test_nested_articles_and_headers_of_sections():
    assert text_of(f"<body><header>Site</header><section><header><h1>The title</h1></header><p>{TEXT}</p><p>And an end.</p></section></body>") == WANT
    nested = f"<body><article><h1>The title</h1><p>{TEXT}</p><article><p>{TEXT}</p></article><article class='comment'><p>{TEXT * 3}</p></article></article></body>"
    assert text_of(nested) == f"The title\n{TEXT.strip()}\n{TEXT.strip()}"


def test_long_comments_stay_out():
    assert text_of(f"<body><article>{BODY}</article><div id='comments'><h3>Replies</h3><p>{TEXT * 9}</p></div></body>") == WANT
    assert text_of(f"<body><div>{BODY}<div class='comment-list'><p>{TEXT * 9}</p></div></div></body>") == WANT


def other_page(rng):
    """A page of another make than the training pages: (html, content words, all words). Content words end in z."""
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8)))
    own = lambda a, b: " ".join(word() + "z" for _ in range(rng.randint(a, b)))
    alien = lambda a, b: " ".join(word() + "x" for _ in range(rng.randint(a, b)))
    parts = [f"<h1 class='t'>{own(2, 8)}</h1>", f"<span class=date>{own(1, 3)}</span>"]
    for _ in range(rng.randint(2, 9)):
        parts.append(rng.choice([f"<p>{own(20, 60)}</p>", f"<p>{own(5, 20)} <em>{own(1, 3)}</em>, {own(9, 30)}", f"<h3>{own(1, 4)}</h3><p>{own(12, 40)}</p>", f"<ol><li>{own(6, 14)}<li>{own(6, 14)}</ol>", f"<pre>{own(10, 20)}</pre>"]))
    if rng.random() < 0.3:
        parts.insert(2, f"<aside class='pull'>{alien(8, 20)}</aside>")
    shell = rng.choice(["<article>%s</article>", "<div class='post-body'>%s</div>", "<main><section>%s</section></main>", "<td>%s</td>"])
    links = "".join(f"<a href='/{k}'>{alien(1, 2)}</a> | " for k in range(rng.randint(3, 8)))
    top = f"<header><b>{alien(1, 3)}</b></header><div role=navigation>{links}</div>"
    end = rng.choice([f"<div class='sidebar'><p>{alien(5, 40)}</p></div>", f"<ul>{''.join(f'<li><a href=#>{alien(2, 5)}</a>' for _ in range(6))}</ul>", ""])
    middle = shell % "".join(parts)
    middle = f"<table><tr>{middle}</tr></table>" if shell.startswith("<td") else middle
    return f"<html><body>{top}{middle}{end}<footer>{alien(5, 20)}</footer><script>var a='{alien(1, 3)}'</script></body></html>"


def test_recall_and_precision_on_other_pages():
    rng = random.Random(77)
    right = found = wanted = 0
    for _ in range(300):
        page = other_page(rng)
        got = text_of(page).replace(",", "").split()
        want = sum(w.endswith("z") for w in " ".join(page.replace("<", " <").replace(">", "> ").split()).replace(",", "").split())
        good = sum(w.endswith("z") for w in got)
        right, found, wanted = right + good, found + len(got), wanted + want
    assert right >= 0.97 * wanted and right >= 0.97 * found, (right, found, wanted)
