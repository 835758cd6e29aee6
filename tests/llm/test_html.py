import collections
import re
import time

import pytest

from lumenweave.llm import html_tree
from tests.llm.html_fixtures import PAGES, UNNAMED


def words(html):
    return re.sub(r"<(style|script|title).*?</\1>|<[^>]*>", " ", html, flags=re.S).split()


def rates_by_part(pages):
    """Recall of the main text and what is let through of each other part, in words, and the share of the kept words that is main text."""
    texts = html_tree.main_texts(["".join(h for _, h in page) for page in pages.values()], html_tree.trained())
    n, kept, whole = collections.Counter(), collections.Counter(), 0
    for page, text in zip(pages.values(), texts, strict=True):
        left = collections.Counter(text.split())
        whole += sum(left.values())
        for part, html in sorted(page, key=lambda x: x[0] != "text"):
            for w in words(html):
                n[part] += 1
                kept[part] += left[w] > 0
                left[w] -= left[w] > 0
    rates = {part: kept[part] / n[part] for part in n}
    print({p: round(r, 3) for p, r in rates.items()}, "precision", round(kept["text"] / whole, 3))
    return rates, kept["text"] / whole


@pytest.mark.parametrize("pages", [PAGES, UNNAMED], ids=["other layouts", "names in no list"])
def test_pages_that_nothing_was_fitted_to(pages):
    rates, precision = rates_by_part(pages)
    assert rates["text"] >= 0.97 and precision >= 0.97
    assert all(r <= 0.25 for part, r in rates.items() if part != "text")


def test_names_of_the_second_set_are_in_no_list():
    names = {n for page in UNNAMED.values() for part, html in page if part != "text" for v in re.findall(r"<div (?:class|id)='([^']*)'", html) for n in html_tree._read_names(f"class='{v}'")[0]}
    assert names and not names & set(html_tree.BAD_WORDS) and "!bad" not in names


def test_names_do_not_decide_alone():
    prose = "<p>The samples were taken in May, dried for a week and weighed by two people who did not know of each other.</p>" * 3
    page = f'<body><div id="content"><div class="related-work"><h2>Related work</h2>{prose}</div><div class="method">{prose}</div></div></body>'
    assert html_tree.main_texts([page], html_tree.trained())[0].count("weighed") == 6


@pytest.mark.parametrize("piece", ["<a ", '<a href="', "<div>", "<a x=\"'>", "<!--", "< ", "<b><p>", "<ul><li>x", "</div>", "<script>", "<a =\"", "<table><td>"])
def test_broken_pages_take_linear_time(piece):
    model = html_tree.trained()
    took = []
    for size in (1 << 18, 1 << 20):
        began = time.perf_counter()
        html_tree.main_texts([piece * (size // len(piece))], model)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5  # four times the length


def test_ends_of_pages_and_tags():
    m = html_tree.trained()
    pages = ['<p title="a > b">one</p><p x=it\'s>two</p>', "<p>one</p><p>two <a href='x", "<p>one<!-- no end", "<p>1 < 2 and 3 <4></p>", "<p>one</p><script>x</scripts>", "<b><p>one</b> two</p>", "<p>a&nbsp;&lt;b&gt; &#233;&eacute;</p><!--> <p>c</p>"]
    assert html_tree.main_texts(pages, m) == ["one two", "one two", "one", "1 < 2 and 3 <4>", "one", "one two", "a <b> éé c"]


def test_long_pages_and_empty_tables(spark):
    long = "<article>" + "<p>word word, and more of it.</p>" * 40_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", long), (2, None, "<div>" * 5000 + "deep down</div>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_tree.extract(rows).collect()}
    assert got[1].n_chars == 40_000 * 27 - 1 and got[2].text in ("deep down", "")
    assert html_tree.extract(rows.limit(0)).count() == 0
