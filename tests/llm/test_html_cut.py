"""Pages without clean landmarks: the cut, not a word list, has to find the article."""

import random
import time

import pytest

from brindle.llm import html_extract as H

LONG = "This sentence belongs to the article and goes on for quite a while, as sentences of articles do, until it ends."
MORE = "Another paragraph follows here; it is just as long as the one before it and holds no link at all, only words."
ART = f"<h1>A title</h1><p>{LONG}</p><p>{MORE}</p>"
TEXT = f"A title\n{LONG}\n{MORE}"
LINKS = "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8))

PAGES = {
    "hidden inside a class name": (f'<div class="overflow-hidden">{ART}</div>', TEXT),
    "hidden as an attribute's value": (f'<div data-state="hidden">{ART}</div>', TEXT),
    "hidden attribute": (f"<div>{ART}</div><div hidden><p>{MORE}</p></div>", TEXT),
    "hidden by style": (f'<div>{ART}</div><div style="display: none"><p>{MORE}</p></div>', TEXT),
    "reader comment": (f'<article>{ART}</article><div class="post-comments"><p>{LONG}</p><p>I liked it a lot, thank you for it.</p></div>', TEXT),
    "main-sidebar": (f'<div class="content">{ART}</div><div class="main-sidebar"><p>{MORE}</p></div>', TEXT),
    "legal-analysis": (f'<div class="legal-analysis">{ART}</div>', TEXT),
    "comments as nested articles": (f'<article>{ART}<section><article class="comment"><p>{LONG}</p></article><article class="comment"><p>{MORE}</p></article></section></article>', TEXT),
    "page-wide form": (f'<form action="/"><div class="top"><a href="/">Home</a> <a href="/b">Shop</a></div><div>{ART}</div></form>', TEXT),
    "small form": (f"<div>{ART}</div><form><p>Please leave your address here, so that we can write to you often.</p></form>", TEXT),
    "layout named after its sidebar": (f'<div class="layout-sidebar"><main>{ART}</main><div class="sidebar"><p>Sidebar words. They are many.</p></div></div>', TEXT),
    "has-sidebar": (f'<div class="has-sidebar">{ART}</div>', TEXT),
    "body class": (f'<body class="has-menu banner">{ART}</body>', TEXT),
    "post-header": (f'<article><div class="post-header"><h1>A title</h1></div><p>{LONG}</p><p>{MORE}</p></article>', TEXT),
    "article-footer": (f'<div class="article">{ART}<div class="article-footer"><p>Filed under things. Share this with friends.</p></div></div>', TEXT),
    "cookie notice": (f'<div id="cookieNotice"><p>We use cookies to make this site better for you. You may accept them.</p></div><div>{ART}</div>', TEXT),
    "roles": (f'<div role="banner"><h1>The Site</h1></div><div role="navigation"><ul>{LINKS}</ul></div><div role="main">{ART}</div><div role="contentinfo"><p>About us.</p></div>', TEXT),
    "related cards are articles too": (f'<main><article>{ART}</article></main><div class="related-posts"><article><h3>Other story</h3><p>A teaser of a story that is not this one.</p></article></div>', TEXT),
    "menu without any class": (f"<ul>{LINKS}</ul><div>{ART}</div>", TEXT),
    "tables as layout": (f"<table><tr><td><ul>{LINKS}</ul></td><td>{ART}</td></tr></table>", TEXT),
    "adverts between paragraphs": (f'<div class="story"><h1>A title</h1><p>{LONG}</p><div class="ad-slot"><p>Buy now, this offer ends today.</p></div><p>{MORE}</p></div>', TEXT),
    "unmarked copyright": (f"<div>{ART}</div><div>© 2020 The Site. All rights reserved.</div>", TEXT),
    "end tags without elements": (f"</section></section><div>{ART}</div></article></p></main>", TEXT),
    "quotes and signs in attributes": (f'<div title="a > b" class=\'content\'>{ART}</div>', TEXT),
    "newsletter box inside the article": (f'<article><h1>A title</h1><p>{LONG}</p><div class="newsletter-signup"><p>Get our letter every week. It is free.</p></div><p>{MORE}</p></article>', TEXT),
    "screen reader text": (f'<main><p class="sr-only">Skip to the main content of this page.</p>{ART}</main>', TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert H.main_text(page) == want


def labels(page):
    """(texts, labels by the odds alone, labels by the cut)."""
    blocks = H.blocks_of(page)
    odds = [H.log_odds(b) for b in blocks]
    return [b.text for b in blocks], [x >= 0 for x in odds], H.cut(odds, H.smoothness(blocks))


def test_the_cut_keeps_short_lines_of_an_article():
    """A linked line is no content by itself, but among paragraphs it is."""
    page = f"<ul>{LINKS}</ul><div><h2>Title</h2><p>{LONG}</p><p>Not so.</p><p><a href=x>See the full report here.</a></p><p>{MORE}</p></div>"
    texts, alone, by_cut = labels(page)
    i = texts.index("See the full report here.")
    assert not alone[i] and by_cut[i] and by_cut[texts.index("Not so.")]
    assert H.main_text(page) == f"Title\n{LONG}\nNot so.\nSee the full report here.\n{MORE}"


def test_the_cut_drops_a_lone_sentence_among_links():
    page = f"<div>{'<p><a href=1>Politics and more</a></p>' * 3}<p>All the news of today.</p>{'<p><a href=1>Sports</a></p>' * 3}</div><hr><div><div><div><div>{ART}</div></div></div></div>"
    texts, alone, by_cut = labels(page)
    i = texts.index("All the news of today.")
    assert alone[i] and not by_cut[i]
    assert H.main_text(page) == TEXT


def test_the_cut_decides_on_unmarked_pages():
    """On generated pages of divs, with captioned link lists about the article and linked lines inside, the cut mends labels."""
    rng = random.Random(3)
    changed = wrong = wrong_alone = 0
    for _ in range(60):
        article = [LONG if rng.random() < 0.6 else rng.choice(["Well.", "So it was.", "He said no.", MORE]) for _ in range(12)]
        for k in range(rng.randint(1, 3), 11, 4):
            article[k - 1 : k + 2] = [LONG, "<a href=z>See there for all of it.</a>", LONG]
        head = "".join(f"<div><a href={k}>Topic number {k}</a></div>" for k in range(rng.randint(3, 9)))
        foot = "".join(f"<div><a href={k}>More of {k}</a></div>" for k in range(rng.randint(3, 9)))
        head, foot = (f"{x}<div>More of this on the next page</div>{x}" for x in (head, foot))
        page = f"<div>{head}</div><div><div>{''.join(f'<p>{x}</p>' for x in article)}</div></div><div>{foot}</div>"
        texts, alone, by_cut = labels(page)
        want = [not t.startswith(("Topic", "More of")) for t in texts]
        changed += sum(a != b for a, b in zip(alone, by_cut, strict=True))
        wrong += sum(a != b for a, b in zip(want, by_cut, strict=True))
        wrong_alone += sum(a != b for a, b in zip(want, alone, strict=True))
    assert changed > 100 and wrong == 0 and wrong_alone > 100


def test_many_undecided_blocks_take_under_a_second():
    rng = random.Random(1)
    n = 5000
    odds = [rng.uniform(-1, 1) for _ in range(n)]
    edges = {(i - 1, i): rng.uniform(0.5, 2) for i in range(1, n)} | {(i - 3, i): 0.5 for i in range(3, n, 7)}
    began = time.process_time()
    kept = H.cut(odds, edges)
    assert time.process_time() - began < 1.0 and len(kept) == n


def test_long_odd_pages_are_linear():
    began = time.process_time()
    page = "<div>" * 50_000 + "<li>x</section>" * 50_000 + "<p>Some last words of it.</p>"
    H.main_text(page)
    assert time.process_time() - began < 20


TOLD = "<p>The council met on Tuesday to discuss the new bridge, and members spoke for two hours about its cost.</p><p>After the debate, a vote was held and the plan was accepted by a narrow margin of three votes.</p>"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
WRAPPERS = "elementor-widget-container|promo-story|social-policy|widget-content|entry-content|wp-block-group|et_pb_text_inner|field--name-body node__content|region region-content|vc_column-inner wpb_wrapper|elementor elementor-kit-5 elementor-page|elementor-widget-wrap|fl-rich-text|site-content|td-post-content|post-body entry-content|comment-on-the-law|newsletter-archive-issue|cookies-recipe|banner-history|related-work-analysis|login-systems-explained|sponsored-content-analysis|block-system-main-block|views-row|paywall-economics|the-sidebar-effect|modal-logic|nav-history"


@pytest.mark.parametrize("name", WRAPPERS.split("|"))
def test_wrappers_with_usual_names_keep_the_text(name):
    want = TOLD.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
    for page in (f'<body>{MENU}<div class="{name}">{TOLD}</div></body>', f'<html><body><div id="{name}">{TOLD}</div>{MENU}</body></html>', f'<body><article class="{name}">{TOLD}</article></body>'):
        assert H.main_text(page) == want


@pytest.mark.parametrize(
    "extra",
    [
        "<div><p>We use cookies to improve your experience. By browsing you accept this.</p></div>", "<div><p>Subscribe to our newsletter and get the best stories in your inbox.</p></div>",
        "<div><h3>Comments (2)</h3><p>Anna: I think that the bridge is far too expensive for a town like ours, really.</p><p>Karl: It will pay for itself in a few years, you will see how it goes.</p></div>",
        "<section><header><h2>Readers' comments</h2></header><div><p>It will pay for itself in a few years, you will see how it goes.</p></div></section>",
        '<div class="comment-list"><p>I think that the bridge is far too expensive for a town like ours, really.</p></div>', '<div class="social-icons">Share this on all the networks that you like to use today.</div>',
        '<div class="related-posts"><p>Another story about a bridge that was built long ago here.</p></div>', '<div class="sidebar-widget"><p>About the author who has written many stories over the years.</p></div>', '<div class="newsletter-box"><p>Get it each week, all the stories that matter to you and yours.</p></div>',
    ],
)
def test_unmarked_notices_and_comments_go(extra):
    want = TOLD.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")
    assert H.main_text(f"<body>{MENU}<div>{TOLD}</div>{extra}</body>") == want
    assert H.main_text(f"<body>{MENU}<article>{TOLD}</article>{extra}</body>") == want


def test_prose_outside_structure_is_never_lost():
    for names in ("comments", "sidebar", "ad", "navbar"):
        assert "narrow margin" in H.main_text(f'<body><div class="{names}">{TOLD}</div></body>')
    assert H.main_text(f'<body><div class="{"x"}">{MENU}</div><div class="comments"><p>Short.</p></div></body>') in ("", "Short.")
    assert H.main_text("<body><div><h1>12 Comments</h1>" + TOLD + "</div></body>").count("council") == 1
    assert H.main_text(f"<body><nav>{TOLD}</nav><footer>{TOLD}</footer></body>") == ""


def test_an_advert_longer_than_a_short_article_goes():
    page = f'<body>{MENU}<div class="ad">A long advert that has more words than all of the short article has, by far, it seems.</div><article><h1>A title here.</h1><p>Short text.</p></article></body>'
    assert H.main_text(page) == "A title here.\nShort text."
