"""Pages whose scripts, heads or formulas once took text with them."""

import time

import pytest

from wayloom.llm import html_text

LONG = "Article text that is long enough to be kept as content. And so on, and on."


@pytest.mark.parametrize("page", [
    f"<script>for(i=0;i<n;i++){{x();}}</script><p>{LONG}</p>",
    f"<script>if(a<b)document.write('<!--');</SCRIPT ><p>{LONG}</p>",
    f"<script>var s='it\\'s <p title=\"';</script><p>{LONG}</p>",
    f"<script>x='</scripty>';y=1<z</script><p>{LONG}</p>",
    f"<style>a::before{{content:'<b'}}</style><p>{LONG}</p>",
    f"<html><head><title>no <b</title><meta charset=utf-8><p>{LONG}</p></html>",
    f"<html><head><script>a<b</script><link rel=x><div><p>{LONG}</p></div>",
    f"<div><svg><path d='M0'><title>no</title><svg></svg>no</svg><p>{LONG}</p></div>",
    f"<div><svg><path d='M0'><p>{LONG}</p></div>",
    f"<div><video src=x>no</div><p>{LONG}</p>",
    f"<template><script>'</template>'</script><p>no no no. No no no no no no no no no.</p></template><p>{LONG}</p>",
    f"<!--><p>{LONG}</p><!-- a --!>",
])
def test_no_text_is_swallowed(page):
    assert html_text.main_text(page) == LONG


def test_text_that_is_no_markup_stays_out():
    assert html_text.main_text(f"<p>{LONG}</p><script>for(i=0;i<n;i++)'<p>{LONG}</p>'") == LONG
    assert html_text.main_text(f"<p>{LONG}</p><object><p>{LONG}</p></object><canvas><div>{LONG}</div></canvas>") == LONG


def test_formulas_stay():
    assert html_text.main_text(f"<p>{LONG} So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>") == f"{LONG} So x=1 holds."


@pytest.mark.parametrize("page", [
    f'<article class="post legal"><p>{LONG}</p></article>',
    f"<article><p><a href=x>{LONG}</a></p></article>",
    f'<article><p class="share-price">{LONG}</p></article>',
    f'<article><div class="comment-free"><p>{LONG}</p></div></article>',
    f'<article><p>{LONG}</p><div class="share-buttons"><p>{LONG}</p></div><div id="relatedPosts"><p>{LONG}</p></div></article>',
    f'<article><p>{LONG}</p><section class="reader-xyz"><article class="comment-body"><p>{LONG}</p></article></section></article>',
    f'<div class="newsletter-xyz"><p>{LONG}</p></div><main class="sidebar-left"><p>{LONG}</p></main>',
])
def test_hints_count_whole_and_never_on_the_article(page):
    assert html_text.main_text(page) == LONG


def test_a_linked_heading_of_an_article_stays():
    assert html_text.main_text(f"<article><h2><a href=x>A heading as link</a></h2><p>{LONG}</p></article>") == f"A heading as link\n{LONG}"


def test_tags_end_outside_quotes():
    assert html_text.main_text(f"<p title='a > \"b'>{LONG}</p><p title=\"x<y>z\">{LONG}") == f"{LONG}\n{LONG}"
    assert html_text.main_text(f"<p>{LONG}</p><a 'never ended {LONG}").startswith(LONG)


@pytest.mark.parametrize("part", [
    "<div><p>word and text. ", "<a", '<a b="', "<a 'x\"", "<b>", "</i><b>", "<b><hr>", "<p>word ", "<p>word</p><p>Words that are long. And so on.</p>", "<li><a>abc def</a>", "<svg><g>", "<!-", "&amp",
])
def test_time_in_proportion_to_the_page(part):
    def took(n):
        began = time.perf_counter()
        html_text.main_text(part * n)
        return time.perf_counter() - began

    assert took(32_000) < 8 * max(took(8_000), 0.5)
