"""Odd markup, the scan against brute force, and time linear in the page."""

import random
import re
import time

import pytest

from pixelweave.llm import html_text

BODY = "<p>" + " ".join(f"w{i}" for i in range(60)) + "</p>"
WORDS = BODY[3:-4]
WEIGHT = {"p": -0.02, "div": -2.0, "a": -0.1, "li": -4.0}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f'<div class="content has-sidebar">{BODY}</div>', WORDS),
        ("<p>Hello <a title=it's href=/x>big</a> wide world of words that goes on to the end</p>", "Hello big wide world of words that goes on to the end"),
        ("<p>" + "İ" * 30 + "<script>x</script> more text follows here</p>", "İ" * 30 + " more text follows here"),
        (f"<DIV CLASS='ad'>Buy this</DIV>{BODY}<Div id=cookie-notice>we use cookies</div>", WORDS),
        (f"{BODY}<div class=ad><div>never closed<article>{BODY}</article>", WORDS),
        (f"<article>{BODY}<div class='comments list'><p>Reader says</p></div></article><p>{'out ' * 200}</p>", WORDS),
        (f"<div class=sidebar>{BODY}</div>", WORDS),  # nothing else is there
        (f"<article>{BODY}<p class=notice>gone<div>all this stays here too</div></article>", WORDS + " all this stays here too"),
        (f"<article>{BODY}<span class=ad>gone</span> and <b>bold</i></b></article>", WORDS + " and bold"),
        ("<p>a < b and 3 <4 &amp; c</p>", "a < b and 3 <4 & c"),
        ("<p>text <!-- no <p>words</p> --> on<!--> and on<!-- open", "text on and on"),
        ("<p>text <!-- open <b>bold</b> and more", "text"),
        ("<p>text <!--x--!> on <!---> and <b>on</b>", "text on and on"),
        ("<p>one</p><textarea>no</textarea x><p>two <b", "one two <b"),
        ("<p title='a>b' data-x = \"c>d\">quoted</p>", "quoted"),
        ("<p>x x x</p></div></p></nav>y y y", "x x x y y y"),
        ("<a b='c", "<a b='c"),
        ("<svg/><p>after</p>", "after"),
        ("<p data-class=ad>kept words</p>", "kept words"),
    ],
)
def test_markup(page, expected):
    assert html_text.main_text(page, WEIGHT) == expected


def test_best_region_by_force():
    rng = random.Random(1)
    for _ in range(500):
        scores = [rng.choice([3.0, 1.0, -1.0, -2.5, -0.5, 0.0]) for _ in range(rng.randrange(0, 14))]
        a, b = html_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(best, 0)


def test_main_text_by_force():
    """Pages without names: the words of the best of all contiguous regions."""
    rng = random.Random(7)
    for _ in range(200):
        items = [rng.choice(["<p>", "</p>", "<div>", "</div>", "<li>", "<a href=x>", "</a>", "w%d x%d y%d" % ((rng.randrange(99),) * 3), "z"]) for _ in range(rng.randrange(1, 15))]
        items = re.sub(r"(?<=[^>])\t(?=[^<])", " ", "\t".join(items)).split("\t")
        score = [float(len(x.split())) if x[0] != "<" else WEIGHT[x.strip("</>").split()[0]] for x in items]
        best = max(sum(score[i:j]) for i in range(len(items)) for j in range(i, len(items) + 1))
        found = html_text.main_text("".join(items), WEIGHT)
        regions = [items[i:j] for i in range(len(items)) for j in range(i, len(items) + 1) if abs(sum(score[i:j]) - best) < 1e-9]
        assert found in {" ".join("".join("" if x in ("<a href=x>", "</a>") else " " if x[0] == "<" else x for x in r).split()) for r in regions}


@pytest.mark.parametrize("unit", ["<label>", "<div class=ad>", "<a ", "<a b='", '<a b="', "<!--", "</p>", "<b>", "<b></i>", "<p><b>", "<script", "<textarea>", "<p><div>", "<i><div></i>", "< ", "&amp", "<![CDATA["])
def test_linear(unit):
    def took(n):
        page = f"<p>some words</p><i>{unit * n}"
        began = time.process_time()
        html_text.main_text(page, WEIGHT)
        return time.process_time() - began

    took(1000)
    assert min(took(40_000) for _ in range(2)) < 12 * max(0.01, min(took(10_000) for _ in range(2)))


def test_names():
    gone = ["ad", "ad banner", "AD", "cookie-notice", "comments", "reader-comments", "readerComments", "comment-list", "comment_body-12", "site-footer", "navbarTop", "post-comments", "related-posts", "x share-buttons", "top-ad", "newsletter_signup"]
    stay = ["content has-sidebar", "with-header", "article-header", "post", "adequate", "bad", "headline", "story-body", "commentary", "no-ads", "main", "header-content", "", "-", "日本"]
    for name in gone:
        assert html_text.main_text(f"<article>{BODY}<div class='{name}'>some words of another kind here</div></article>", WEIGHT) == WORDS, name
    for name in stay:
        assert html_text.main_text(f"<article>{BODY}<div class='{name}'>some words of another kind here</div></article>", WEIGHT) == WORDS + " some words of another kind here", name
