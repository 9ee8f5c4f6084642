"""Main text where pages mark articles in misleading ways or leave end tags out."""

import html
import random
import re

import pyarrow.parquet as pq
import pytest

from quillspark.llm import html_text

LONG = "A sentence of the story that is long enough to count as a line of running text in any window. " * 2
STORY = LONG.strip()


def test_windows_decide_on_marked_pages():
    page = f"<body><article><p>Teaser.</p></article><nav>a</nav><nav>b</nav><div>{LONG}</div><div>{LONG}</div></body>"
    assert html_text.main_text(page).split("\n")[-2:] == [STORY, STORY]
    short = "<article><p>One.</p><p>Two.</p></article>" + "".join(f"<nav>{i}</nav>" for i in range(4))
    assert html_text.main_text(f"<body>{short}<div>{LONG}</div></body>") == STORY


def test_marks_add_less_than_a_window_needs():
    gap = "<nav>x</nav>" * 3
    line = "y" * 20
    inside = f"<main><p>{line}</p><p>{line}</p><p>{line}</p></main>"
    assert html_text.main_text(f"<body><p>{line}</p><p>{line}</p><p>{line}</p>{gap}<p>{LONG}</p></body>") == STORY
    assert html_text.main_text(f"<body>{inside}{gap}<p>{LONG}</p></body>").count(line) == 3


def test_comments_marked_as_articles_are_no_story():
    page = f'<body><div>{LONG}</div><div>{LONG}</div><ol><li class="comment"><article class="comment-body"><p>{"reader " * 30}</p></article></li></ol></body>'
    assert html_text.main_text(page) == f"{STORY}\n{STORY}"
    assert html_text.main_text(f'<body><div>{LONG}</div><article class="comment"><p>{"reader " * 30}</p></article></body>') == STORY


@pytest.mark.parametrize(
    "page",
    [
        f"<ul><li class=ad>Buy now<li>{LONG}</ul>",
        f"<ul><li class=ad>Buy now</ul><div>{LONG}</div>",
        f"<div><p class=ad>Buy now</div><div>{LONG}</div>",
        f"<p class=ad>Buy now<p>{LONG}",
        f"<p class=ad>Buy now<div>{LONG}</div>",
        f"<dl><dt class=ad>Buy<dd>{LONG}</dl>",
        f"<div class=ad>Buy <b>now</div></b><div>{LONG}</div>",
    ],
)
def test_a_skipped_part_ends_where_its_end_tag_is_implied(page):
    assert html_text.main_text(f"<body>{page}</body>") == STORY


def test_main_inside_a_part_named_as_aside_counts():
    assert html_text.main_text(f'<body><div class="sidebar-layout"><main><p>{LONG}</p></main><p>beside</p></div></body>') == STORY


def brute_kept(weights, threshold, window):
    """By the definition: a line stays if some surge can be walked to from it without crossing a dive."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    return [any(s > threshold and all(x > 0 for x in sums[min(i, j) : max(i, j) + 1]) for j, s in enumerate(sums)) for i in range(len(sums))]


def test_surges_and_dives_against_the_definition():
    r = random.Random(3)
    for _ in range(300):
        weights = [r.choice([0, 0, 0, 5, 20, 60, 200]) for _ in range(r.randint(0, 25))]
        threshold, window = r.choice([0, 10, 86, 150]), r.choice([1, 2, 3, 8])
        assert html_text.kept(weights, threshold, window) == brute_kept(weights, threshold, window)


def test_threshold_and_window_change_the_text():
    """Short lines, a gap of two lines, a long line: what is kept follows from the distribution alone."""
    gap = "<ul><li><a href=x>one link</a><li><a href=y>another</a></ul>"
    page = f"<body><div>{'s' * 40}</div>{gap}<div>{LONG}</div>{gap}{gap}<div>{'t' * 40}</div></body>"
    assert html_text.main_text(page, 86, 3) == f"{'s' * 40}\none link\nanother\n{STORY}"
    assert html_text.main_text(page, 86, 1) == STORY
    assert html_text.main_text(page, 30, 1) == f"{'s' * 40}\n{STORY}\n{'t' * 40}"
    assert html_text.main_text(page, 500, 3).count("\n") == 2  # no surge: all lines of weight


def test_article_marks_are_not_needed():
    """On generated pages the text is the same with article and main as plain division."""
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    for row in rows:
        bare = re.sub(r"(</?)(?:article|main)\b[^>]*>", r"\1div>", row["html"])
        article = re.search(r"<article[^>]*>(.*)</article>", row["html"], re.S)[1]
        words = html.unescape(re.sub(r"<[^>]+>", " ", article)).split()
        assert html_text.main_text(row["html"]) == html_text.main_text(bare) and html_text.main_text(bare).split() == words


def test_very_long_and_broken_pages():
    long = "<p>" + "word " * 400_000 + "</p>"
    assert len(html_text.main_text(f"<article>{long}</article>")) == 5 * 400_000 - 1
    assert html_text.main_text("<b>" * 20_000 + LONG) == STORY


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
