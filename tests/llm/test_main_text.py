"""Surge and dive decide on every page; article and main only weigh."""

import random
import time

import pytest

from chronofold.llm.html_text import main_text

LONG = "A sentence of the article that is long enough to count as a line of text."


def test_linked_lines_inside_the_article_stay():
    links = "".join(f"<li><a href=x>Reference number {i}</a>" for i in range(5))
    page = f"<nav><a href=x>Menu</a></nav><article><h1><a href=x>Linked headline here</a></h1><p>{LONG}<ul>{links}</ul></article>"
    assert main_text(page).split("\n") == ["Linked headline here", LONG, *(f"Reference number {i}" for i in range(5))]


def test_text_outside_a_teaser_article_stays():
    page = f"<article><p>Teaser text that leads on to another page of the site.</article><div><p>{LONG}<p>{LONG}</div>"
    assert main_text(page).count(LONG) == 2


def test_links_outside_the_article_go():
    links = "".join(f"<li><a href=x>Other page {i}</a>" for i in range(5))
    assert main_text(f"<ul>{links}</ul><article><p>{LONG}</article><ul>{links}</ul>") == LONG


def test_short_headlines_before_the_surge_stay():
    short = "".join(f"<p>Re {i}" for i in range(6))
    assert main_text(f"<article>{short}<p>{LONG}</article>").split("\n") == [*(f"Re {i}" for i in range(6)), LONG]


@pytest.mark.parametrize("name", ["post no-sidebar", "has-comments", "topic-social-science", "with-share", "searchable", "navigator-story"])
def test_names_that_only_contain_a_label(name):
    assert main_text(f"<article><div class='{name}'><p>{LONG}<p>{LONG}</div></article>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["sidebar", "site-header", "comment-list", "cookie-banner", "ad slot-3", "related_posts", "newsletter-signup"])
def test_names_that_are_labels(name):
    assert main_text(f"<article><p>{LONG}<div class='{name}'><p>Another {LONG}</div><p>{LONG}</article>") == f"{LONG}\n{LONG}"


def test_menus_between_paragraphs():
    menu = "<nav><a href=x>Menu</a></nav>"
    assert main_text(f"{menu}<p>{LONG}<p>{LONG}{menu * 4}<div><p>The end.</div>") == f"{LONG}\n{LONG}\nThe end."


@pytest.mark.parametrize("tag", ["<p title=don't>", "<p title='a>b'>", '<p title="it\'s > that">', "<p data-x = 'y'>", "<p\ntitle=x/y>", "<P CLASS=lead>"])
def test_attributes_leave_no_trace(tag):
    assert main_text(f"<article>{tag}{LONG}</p><p>{LONG} It's.</article>") == f"{LONG}\n{LONG} It's."


@pytest.mark.parametrize("part", ["<p a='b ", '<a href="x>', "</script", "<div>", "</section>", "<!-- x", "<", "<b", "<p class=x'y>"])
def test_broken_pages_take_linear_time(part):
    page = "<article>" + part * (1_000_000 // len(part)) + f"<p>{LONG}"
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 8  # a square of the length would take minutes


def test_made_pages_give_back_their_articles():
    """Pages of random articles and boilerplate against what they were made of."""
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "中文", "&amp;", "<b>bold</b>", "<a href='/x'>link</a>"]
    plain = {"&amp;": "&", "<b>bold</b>": "bold", "<a href='/x'>link</a>": "link"}
    say = lambda n: [r.choice(words) for _ in range(n)]
    text = lambda w: " ".join(plain.get(x, x) for x in w)
    for _ in range(120):
        blocks = [say(r.randint(1, 40)) for _ in range(r.randint(1, 12))] + [say(30)]
        junk = lambda: "".join(r.choice([f"<nav><ul><li><a href=/>{r.choice('abc')}</a></ul></nav>", f"<div class=ad>{' '.join(say(20))}</div>", "<!-- <p>no</p> -->", "<script>'<p>no</p>'</script>", "<style>p{}</style>", f"<form><p>{' '.join(say(9))}</form>"]) for _ in range(r.randint(0, 4)))
        body = "".join(r.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<ul><li>{}</ul>", "<h2 id=a>{}</h2>"]).format(r.choice([" ", "\n\t "]).join(b)) + (junk() if r.random() < 0.3 else "") for b in blocks)
        page = f"<html><head><title>no</title></head><body>{junk()}<article>{body}</article>{junk()}<footer><p>{' '.join(say(30))}</footer>"
        assert main_text(page).split("\n") == [text(b) for b in blocks]
