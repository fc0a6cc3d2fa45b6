"""Main text where names and elements mislead or are missing."""

import re

import pytest

from pairlake.llm import html_text

LONG = "The man of the house is in it and he was on the way to the end of all that we have seen there. "
SOME = "It was not for the first time that they had to be there with all of it, but she said that he was by the river."


@pytest.mark.parametrize("tag", ['<div style="overflow:hidden">', '<div data-state="not hidden">', '<div data-note="display:none">', '<div title="hidden">', "<div class='searchable'>", '<section class="search">', '<div class="notice">', '<div id="alert">', '<section class="related">', '<p class="share">', '<div role="search">'])
def test_long_text_stays(tag):
    """Neither other attributes nor names that main text may bear lose long text."""
    assert html_text.main_text(f"<body><article>{tag}{LONG * 3}</article></body>") == (LONG * 3).strip()


@pytest.mark.parametrize("tag", ["<div hidden>", '<div hidden="">', '<div aria-hidden="true">', "<div style='color:red; DISPLAY : none'>", '<div class="comments">', '<div class="cookie-notice">', '<div class="ad">', "<aside>", "<nav>", '<div id=sidebar>', '<div role="navigation">'])
def test_hidden_and_boilerplate_go(tag):
    end = "</" + re.match(r"<(\w+)", tag)[1] + ">"
    assert html_text.main_text(f"<body><p>{LONG}</p>{tag}<p>{LONG * 3}</p>{end}<p>{SOME}</p></body>") == LONG + SOME


def test_header_of_an_article():
    page = f'<header><p>{LONG}</p></header><article><div class="header"><h1>The title</h1></div><header class="entry-header"><p>By her</p></header><p>{LONG * 2}</p></article>'
    assert html_text.main_text(page) == "The title By her " + (LONG * 2).strip()


def test_weak_names_decide_what_is_open():
    page = f'<p>{LONG * 2}</p><div class="share"><p>Tell your friends</p></div><section class="related"><h2>More</h2><ul><li><a href=x>One of them</a></li></ul></section><p>{LONG}</p>'
    assert html_text.main_text(page) == (LONG * 3).strip()


def renamed(page):
    """The page with nothing but div, p, li, a and headings, and no class names."""
    page = re.sub(r"<(/?)(?:nav|footer|article|aside|header|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r'<div class="[^"]*">', "<div>", page)


def test_without_telling_names(spark):
    """The measures alone, on pages without names or containers: nearly all of the main text, and little else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    kept = lost = wrong = same = 0
    for r in rows:
        want, got = html_text.main_text(r.html).split(), html_text.main_text(renamed(r.html)).split()
        same += want == got
        both = len(set(want) & set(got))
        kept, lost, wrong = kept + both, lost + len(set(want) - set(got)), wrong + len(set(got) - set(want))
    print(len(rows), same, kept, lost, wrong)
    assert lost < 0.02 * (kept + lost) and wrong < 0.02 * (kept + wrong) and same > 0.75 * len(rows)
